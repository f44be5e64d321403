"""Order documents: projection, merge of a refreshed batch, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.places import beside, counts_before, in_ranges
from tideline.sources.schemas import LINES

#: Known orders that an incremental run looks at again, and orders of a page.
KNOWN_WINDOW, PAGE_ROWS = 250, 50

FIELDS = ("id", "status", "date_created", "paid_amount", "total_amount", "order_items", "buyer", "shipping")


def slim_orders(raw: DataFrame) -> DataFrame:
    """The kept fields of order documents. A missing buyer or shipping stays missing; cancel details go."""
    item = lambda x: F.struct(*[x["item"][f].cast("string").alias(f) for f in ("id", "title", "seller_sku", "variation_id")])
    line = lambda x: F.struct(x["quantity"].cast("double").alias("quantity"), x["unit_price"].cast("double").alias("unit_price"), item(x).alias("item"))
    buyer = F.when(F.col("buyer").isNotNull(), F.struct(F.col("buyer.nickname").cast("string").alias("nickname")))
    shipping = F.when(F.col("shipping").isNotNull(), F.struct(F.col("shipping.id").cast("string").alias("id"), F.col("shipping.logistic_type").cast("string").alias("logistic_type")))
    lines = F.transform("order_items", line)
    return raw.select(
        F.col("id").cast("string").alias("id"),
        "status",
        "date_created",
        F.col("paid_amount").cast("double").alias("paid_amount"),
        F.col("total_amount").cast("double").alias("total_amount"),
        F.coalesce(lines, F.array().cast(LINES)).alias("order_items"),
        buyer.alias("buyer"),
        shipping.alias("shipping"),
        "ordinal",
    )


def fingerprint(df: DataFrame) -> Column:
    """Two independent hashes of a row's document fields."""
    own = [c for c in FIELDS if c in df.columns and c != "id"]
    text = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    return F.struct(F.xxhash64(text).alias("h"), F.md5(text).alias("m"))


def changes(base: DataFrame, refreshed: DataFrame) -> DataFrame:
    """The refreshed rows with change: new, changed or same."""
    old = base.select(F.col("id").alias("__id"), fingerprint(base).alias("__old"))
    held = refreshed.withColumn("__new", fingerprint(refreshed)).join(old, F.col("id") == F.col("__id"), "left")
    kind = F.when(F.col("__id").isNull(), "new").when(F.col("__old") != F.col("__new"), "changed").otherwise("same")
    return held.withColumn("change", kind).drop("__id", "__old", "__new")


def change_counts(base: DataFrame, refreshed: DataFrame) -> DataFrame:
    """One row: new, changed, same."""
    return changes(base, refreshed).agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("new", "changed", "same")])


def merge_orders(base: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Union by id: refreshed rows come first, of repeated ones the first seen."""
    both = refreshed.withColumn("__age", F.lit(0)).unionByName(base.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("__age", F.asc_nulls_last("ordinal")))
    return both.withColumn("__n", rank).where("__n = 1").drop("__n", "__age")


def known_orders(refreshed: DataFrame, base: DataFrame) -> DataFrame:
    return refreshed.join(base.select("id"), "id", "left_semi")


def unknown_orders(refreshed: DataFrame, base: DataFrame) -> DataFrame:
    return refreshed.join(base.select("id"), "id", "left_anti")


def known_window(refreshed: DataFrame, base: DataFrame, order: list[Column], window: int = KNOWN_WINDOW, page: int = PAGE_ROWS) -> DataFrame:
    """What an incremental run reads of a source's orders: position (from 0), known, and the orders.

    It ends with the page on which the window-th known order stands; with fewer known ones it
    reads all. The place of that order is found from the counts of ranges and from its own range.
    order ends with something unique; of repeated ids each row counts.
    """
    known = base.select(F.col("id").alias("__known")).distinct()
    rows = refreshed.join(known, F.col("id") == F.col("__known"), "left").withColumn("known", F.col("__known").isNotNull()).drop("__known")
    placed = in_ranges(rows, order)
    counts = counts_before(placed, known=F.col("known"))
    crossing = counts.where((F.col("before_known") < window) & (F.col("before_known") + F.col("known") >= window)).select("part", "before", "before_known")
    own = placed.where("known").join(F.broadcast(crossing), "part")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("place"))
    last = own.withColumn("rank", F.col("before_known") + rank).where(F.col("rank") == window).select((F.col("before") + F.col("place")).alias("last"))
    end = last.agg(F.max("last").alias("last")).select(((F.floor(F.col("last") / page) + 1) * page).alias("end"))
    held = beside(placed, counts.select("part", "before"), ["part"]).withColumn("position", F.col("before") + F.col("place"))
    held = held.join(F.broadcast(end), F.col("end").isNull() | (F.col("position") < F.col("end")))
    return held.drop("part", "place", "before", "end")
