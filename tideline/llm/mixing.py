"""Mixing of sources to target weights by Poisson replication.

A source with rate r gives every one of its documents a Poisson number of copies with mean
r. The number is found by inverting the Poisson distribution at a uniform number hashed
from seed and document, so it depends on neither order nor partitions. A mean above
MAX_MEAN is the sum of equal smaller ones with a hash each, which is exact and keeps the
table of the distribution short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.places import numbered

from .common import Scratch, small_join, uniform_from_hash

#: Means above this are split into equal parts.
MAX_MEAN = 16.0
#: Terms of the distribution function: for a mean of 16 the rest is below 2 ** -53.
TERMS = 80
#: Without target weights a source's share is its row count to this power.
TEMPERATURE = 0.7
SEED = 17


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source_col: str = "source") -> DataFrame:
    """source, n, rate: mean copies of a document so that sources reach their weights.

    weights: relative targets by source, a source that isn't named gets 0; by default
    the temperature rule over row counts. total: documents wanted, as many as there are
    by default. Documents without a source form a source of their own.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    elif not weights:
        weight = F.lit(0.0)
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weight = F.coalesce(F.try_element_at(table, F.coalesce("source", F.lit(""))), F.lit(0.0))
    counts = Scratch(docs.sparkSession, "mixing").save(counts.withColumn("weight", weight), "sources")
    all_n, all_w = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    size = float(all_n if total is None else total)
    rate = F.lit(size) * F.col("weight") / F.lit(all_w) / F.col("n") if all_w > 0 else F.lit(0.0)
    return counts.select("source", "n", rate.alias("rate"))


def poisson_table(rates: DataFrame) -> DataFrame:
    """Adds parts (how many Poisson numbers to add up) and cdf (their distribution function at 0, 1, ...)."""
    mean = F.col("rate") / F.col("parts")
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf"),
        ),
        lambda acc: acc["cdf"],
    )
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_MEAN)).cast("int"))
    return rates.withColumn("parts", parts).withColumn("cdf", steps)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Every document as often as its Poisson number says, in one global random order.

    Adds copy (0, 1, ...) and shuffle_key, in place of input columns of these names; sorted by
    shuffle_key the rows are in the global order, and each output partition is sorted so. The
    same rows give the same copies. Rows with the same id get the same number. Rows without id
    are told apart by their contents, and equal ones by a number among them, so each of them
    has a number of its own. Null texts and empty ones are documents like others; a null source
    is a source of its own. An empty table gives no rows.
    """
    columns = docs.drop("copy", "shuffle_key").columns
    docs = keyed(docs.select(*columns), id_col)
    table = poisson_table(source_rates(docs, weights, total, source_col))
    table = table.select(F.col("source").alias("__src"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    held = small_join(docs.withColumn("__src", F.col(source_col)), table, "__src", F.col("__own"))
    chances = F.transform(F.sequence(F.lit(0), F.col("__parts") - 1), lambda i: uniform_from_hash(F.lit(seed), F.col("__own"), i))
    below = lambda u: F.size(F.filter("__cdf", lambda c: c < u))
    number = F.aggregate("__chances", F.lit(0), lambda acc, u: acc + below(u))
    held = held.withColumn("__chances", chances)
    held = held.withColumn("__n", number).where("__n > 0")
    held = held.select(*columns, "__own", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), "__own", F.col("copy").cast("string")))
    held = held.withColumn("shuffle_key", key).drop("__own")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")


def keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """Adds __own, what a row's numbers are hashed from: its id; without one its contents and its number among equal rows.

    Equal rows are exchangeable, so they are numbered in whatever order they stand, by ranges:
    a table of one text without ids is numbered by all tasks.
    """
    found = docs.withColumn("__own", F.col(id_col).cast("string"))
    without = docs.where(F.col(id_col).isNull())
    if not without.limit(1).count():
        return found
    same = without.withColumn("__same", F.xxhash64(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))).withColumn("__row", F.monotonically_increasing_id())
    twins = numbered(same, [F.asc("__row")], ["__same"], "__twin")
    own = twins.withColumn("__own", F.concat_ws(":", F.lit("~"), F.col("__same").cast("string"), F.col("__twin").cast("string")))
    return found.where(F.col(id_col).isNotNull()).unionByName(own.drop("__same", "__row", "__twin"))
