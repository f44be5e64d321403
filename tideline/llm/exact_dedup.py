"""Exact deduplication by a tree merge of sorted digest runs.

Every scan partition reduces its rows to a run of text digests. In each round, runs
whose numbers agree but for their last bits are exchanged and merged (2 ** fan_in_bits of
them at once, that is fan_in_bits binomial rounds in one exchange), until one run is left.
Spark groups these keys by a sort aggregate: rows are sorted by digest where a run is made,
and runs are merged in order. Each level keeps the smallest identifier of a digest. A digest
stands for a text only together with the text's length and a second, independent hash; rows
that differ in one of them are never merged, at any level.

A text held by a third of all rows reaches each merge as one row per run, at most
2 ** fan_in_bits rows a key, and results go back by (digest, run), so no task gets the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch

FAN_IN_BITS = 4
KEYS = ["digest", "length", "check"]


def normalised(text: str = "text"):
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS + "+", " ")


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    return (
        docs.withColumn("__norm", normalised(text))
        .withColumn("digest", F.unhex(F.sha2("__norm", 256)))
        .withColumn("length", F.length("__norm").cast("long"))
        .withColumn("check", F.xxhash64("__norm"))
        .drop("__norm")
    )


def merge_runs(runs: DataFrame, bits: int, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """Merges runs numbered below 2 ** bits into one; keep: (no id, id, row) as the order of rows."""
    level = runs
    for _ in range(-(-bits // fan_in_bits)):
        level = (
            level.withColumn("run", F.shiftright("run", fan_in_bits))
            .groupBy(*KEYS, "run")
            .agg(F.min("keep").alias("keep"), F.sum("size").alias("size"))
        )
    return level.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays. Null texts are empty texts. A row
    without id stays only if none of its group has one; of repeated rows with the same id
    and text exactly one is kept. Extra columns of the input are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    rows = with_digest(rows, "__text").select(
        *KEYS,
        F.spark_partition_id().alias("run"),
        F.struct(F.col("id").isNull().alias("no_id"), "id", F.monotonically_increasing_id().alias("row")).alias("me"),
    )
    rows = scratch.save(rows, "digests")
    runs = rows.groupBy(*KEYS, "run").agg(F.min("me").alias("keep"), F.count(F.lit(1)).alias("size"))
    runs = scratch.save(runs, "runs")
    last = runs.agg(F.max("run")).first()[0]
    merged = merge_runs(runs, max(1, int(last or 0).bit_length()), fan_in_bits)
    resolved = runs.select(*KEYS, "run").join(merged, KEYS)
    out = rows.join(resolved, [*KEYS, "run"])
    return out.select(
        F.col("me.id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("me.row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """The documents without exact copies, all their columns kept."""
    groups = exact_groups(docs, id_col, text_col, fan_in_bits)
    stay = groups.where("kept").select(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__digest"))
    held = docs.withColumn("__sha", F.unhex(F.sha2(normalised(text_col), 256)))
    on = held[id_col].eqNullSafe(stay["__id"]) & (held["__sha"] == stay["__digest"])
    found = held.join(stay, on)
    # Repeated rows (same id, same text) meet here once more; the join's keys already part them.
    first = Window.partitionBy("__id", "__digest").orderBy("__id")
    found = found.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return found.select(*docs.columns)
