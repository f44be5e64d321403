"""Places in a global order, found in parallel.

Rows are dealt into sorted ranges and kept in the shared folder, so that what numbers them and
what reads them see the same ranges. A row's place is the rows of earlier ranges, counted once
for each range, and its place in its own. Nothing but a row per range (and group) is ordered
in one task, and equal keys don't matter as long as the order ends with something unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of the row's place in Spark's monotonically increasing ids; the part stands above them.
_PLACE_BITS = 33
#: Rows of counts that are broadcast at most; beyond that they are joined by a shuffle.
MOST_COUNTS = 100_000


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there; Spark deletes them when nothing refers to them."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        from tideline.sources.snapshots import shared_folder

        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def in_ranges(rows: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """The rows, sorted, with part (the range) and place (in it, from 0). order ends with something unique."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    own = F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return kept(dealt).withColumns({"part": F.shiftright("__id", _PLACE_BITS).cast("int"), "place": own}).drop("__id")


def counts_before(placed: DataFrame, by: list[str] | None = None, **more: Column) -> DataFrame:
    """One row for each group and part: n, first (its first place in the part), before (rows of the group in earlier parts).

    more: conditions that are counted likewise, as name and before_name.
    """
    by = by or []
    counts = placed.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), *[F.count_if(c).alias(k) for k, c in more.items()])
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = {f"before{'_' + k if k != 'n' else ''}": F.coalesce(F.sum(k).over(earlier), F.lit(0)) for k in ("n", *more)}
    return counts.withColumns(so_far)


def beside(placed: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """placed with its counts: broadcast if they are few, which one row a range always is."""
    return placed.join(F.broadcast(counts) if on == ["part"] or counts.count() <= MOST_COUNTS else counts, on)


def numbered(rows: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "position", ranges: int | None = None) -> DataFrame:
    """The rows with their number from 1 in the order, or within each group; sorted by group and order.

    A group of most rows is dealt over many ranges like any other rows.
    """
    by = by or []
    placed = in_ranges(rows, [*[F.col(c).asc_nulls_first() for c in by], *order], ranges)
    if by:  # nulls make a group of their own
        placed = placed.withColumn("__by", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    on = ["__by", "part"] if by else ["part"]
    counts = counts_before(placed, ["__by"] if by else None).select(*on, "first", "before")
    held = beside(placed, counts, on)
    held = held.withColumn("__number", F.col("before") + F.col("place") - F.col("first") + 1).drop(*on, "place", "first", "before")
    return held.withColumnRenamed("__number", name)
