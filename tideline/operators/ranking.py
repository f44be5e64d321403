"""Product ranking by revenue, units or margin."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import exact, total
from tideline.functions.places import kept, numbered
from tideline.operators.margin import by_locale, percent_of

CRITERIA = ("revenue", "units", "margin")
DEFAULT_LIMIT, MAX_LIMIT = 5, 20


def ranking_limit(n: float | None) -> int:
    """Whole, 1 to 20; 5 where none or nonsense is given."""
    if n is None or not math.isfinite(n):
        return DEFAULT_LIMIT
    return max(1, min(MAX_LIMIT, math.floor(n)))


def ranking_rows(lines: DataFrame, freight: bool = False) -> DataFrame:
    """One row per SKU with everything a ranking shows, from one pass over the lines.

    freight adds freight_real and freight_estimated, and real_revenue, of costed lines.

    Lines are added up by SKU and title, then by SKU: label is the title with the most revenue,
    then the shortest, then the first in order; item_ids are the items, in order.
    cost_coverage: total, parcial or ausente, judged by units; money that needs costs is
    null where it is ausente, and counts the costed part alone where it is parcial.
    """
    costed = F.col("unit_cost").isNotNull()
    sums = {
        "revenue": F.col("revenue"),
        "units": F.col("quantity"),
        "costed_revenue": F.when(costed, F.col("revenue")),
        "costed_units": F.when(costed, F.col("quantity")),
        "uncosted_units": F.when(~costed, F.col("quantity")),
        "marketplace_fee": F.when(costed, F.col("marketplace_fee")),
        "shipping_fee": F.when(costed, F.col("shipping_fee")),
        "cost": F.when(costed, F.col("cost")),
    }
    if freight:
        real, by_share = costed & F.col("real"), costed & ~F.col("real")
        sums |= {"freight_real": F.when(real, F.col("shipping_fee")), "freight_estimated": F.when(by_share, F.col("shipping_fee")), "real_revenue": F.when(real, F.col("revenue"))}
    by_title = lines.groupBy("sku", "title").agg(*[F.sum(exact(v)).alias(c) for c, v in sums.items()], F.count_if("first_of_order").alias("orders"), F.collect_set("item_id").alias("item_ids"))
    named = F.coalesce(F.col("title") != "", F.lit(False))
    label = F.struct(F.coalesce("revenue", F.lit(0)).alias("r"), (-F.length("title")).alias("n"), F.col("title"))
    rows = by_title.groupBy("sku").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(34,8)").alias(c) for c in sums],
        F.sum("orders").alias("orders"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.collect_list(F.when(named, label)).alias("labels"),
    )
    later = lambda a, b: (b["r"] > a["r"]) | (b["r"] == a["r"]) & ((b["n"] > a["n"]) | (b["n"] == a["n"]) & (F.struct(F.collate(b["title"], "UNICODE").alias("t"), b["title"]) < F.struct(F.collate(a["title"], "UNICODE").alias("t"), a["title"])))
    best = F.aggregate("labels", F.get("labels", F.lit(0)), lambda a, b: F.when(later(a, b), b).otherwise(a))
    rows = rows.withColumns({"label": F.coalesce(best["title"], F.lit("")), "items": F.size("item_ids").cast("long")}).drop("labels")
    coverage = F.when(F.col("costed_units") == 0, "ausente").when(F.col("uncosted_units") == 0, "total").otherwise("parcial")
    rows = rows.withColumn("cost_coverage", coverage)
    # Money is subtracted as decimals: doubles would move a margin that ends in half a cent below it.
    rows = rows.withColumn("margin", (F.col("costed_revenue") - F.col("marketplace_fee") - F.col("shipping_fee") - F.col("cost")).cast("double"))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in sums})
    rows = rows.withColumn("margin_pct", percent_of("margin", "costed_revenue"))
    money = ("marketplace_fee", "shipping_fee", "cost", "margin", "margin_pct")
    return rows.withColumns({c: F.when(F.col("cost_coverage") != "ausente", F.col(c)) for c in money})


def eligible(rows: DataFrame, key: str) -> DataFrame:
    """By margin only SKUs whose cost is fully known."""
    return rows.where("cost_coverage = 'total'") if key == "margin" else rows


def first_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n of the ranking rows with their position: a top-n, so nothing else is ordered."""
    order = [F.desc(key), *by_locale()]
    top = eligible(rows, key).orderBy(*order).limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def ranking(lines: DataFrame, criterion: str = "revenue", limit: float | None = None, everything: bool = False) -> DataFrame:
    """The first SKUs by criterion with their position; by margin only SKUs whose cost is fully known.

    An unknown criterion counts as revenue. everything skips the limit; rows are added up once
    and numbered by ranges, so no task orders all of them.
    """
    key = criterion if criterion in CRITERIA else "revenue"
    rows = ranking_rows(lines)
    if everything:
        rows = kept(eligible(rows, key))  # dealing into ranges reads them twice
        return numbered(rows, [F.desc(key), *by_locale()]).withColumn("position", F.col("position").cast("int"))
    return first_rows(rows, key, ranking_limit(limit))


def margin_coverage(rows: DataFrame) -> DataFrame:
    """One row: the share of revenue whose SKUs have fully known costs, and the SKUs left out."""
    full = F.col("cost_coverage") == "total"
    out = rows.agg(total(F.when(full, F.col("revenue"))).alias("covered_revenue"), total("revenue").alias("revenue"), F.count_if(~full).alias("excluded"))
    return out.withColumn("fraction", F.coalesce(F.try_divide("covered_revenue", "revenue"), F.lit(0.0)))


def margin_totals(rows: DataFrame) -> DataFrame:
    """Totals over all ranking rows: fees, cost, margin, and margin_pct over the revenue with known cost."""
    measures = ("revenue", "units", "costed_revenue", "marketplace_fee", "shipping_fee", "cost", "margin")
    out = rows.agg(*[total(c).alias(c) for c in measures], F.count(F.lit(1)).alias("skus"))
    out = out.withColumn("net_revenue", F.col("revenue") - F.col("marketplace_fee") - F.col("shipping_fee"))
    return out.withColumn("margin_pct", percent_of("margin", "costed_revenue"))
