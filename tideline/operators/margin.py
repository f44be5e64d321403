"""Margin: products' revenue less fees, freight and costs, by SKU and in total."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import exact, total
from tideline.functions.dates import in_period
from tideline.operators.costs import Fees, Logistics, with_costs
from tideline.operators.lines import sale_lines

#: Share of revenue without known cost above which a total counts as unavailable.
MOST_WITHOUT_COST = 0.2


def priced_lines(orders: DataFrame, shipments: DataFrame, rules, start: date | None, end: date | None, fees: Fees = Fees(), logistics: Logistics = Logistics()) -> DataFrame:
    """Sale lines of the period with marketplace_fee, shipping_fee, real (freight known), cost, margin; null where the cost is unknown.

    Freight is shared over all sales of a shipment before the period is cut.
    """
    lines = sale_lines(orders, shipments, in_period("civil_date", start, end))
    lines = with_costs(lines, rules, logistics)
    lines = lines.withColumns(
        {
            "marketplace_fee": F.col("revenue") * fees.marketplace,
            "real": F.col("freight_share").isNotNull(),
            "shipping_fee": F.coalesce("freight_share", F.col("revenue") * fees.shipping),
            "cost": F.col("unit_cost") * F.col("quantity"),
        }
    )
    return lines.withColumn("margin", F.col("revenue") - F.col("marketplace_fee") - F.col("shipping_fee") - F.col("cost"))


def percent_of(margin: str, revenue: str) -> Column:
    return F.when(F.col(revenue) > 0, F.try_divide(margin, revenue) * 100)


def shortest_title() -> Column:
    """The shortest title that isn't empty, of equally short ones the first seen: by the order's arrival, then its lines."""
    arrival = [F.col("ordinal").isNull().alias("late"), "ordinal", "order_id", "pos"]
    return F.min(F.when(F.col("title") != "", F.struct(F.length("title").alias("n"), *arrival, "title")))["title"]


def _measures(costed: Column) -> list[Column]:
    known = lambda c: total(F.when(costed, F.col(c)))
    return [
        known("revenue").alias("revenue"),
        known("marketplace_fee").alias("marketplace_fee"),
        known("shipping_fee").alias("shipping_fee"),
        known("cost").alias("cost"),
        known("quantity").alias("units"),
        total(F.when(costed & F.col("real"), F.col("shipping_fee"))).alias("freight_real"),
        total(F.when(costed & ~F.col("real"), F.col("shipping_fee"))).alias("freight_estimated"),
        total(F.when(costed & F.col("real"), F.col("revenue"))).alias("revenue_real_freight"),
        total(F.when(~costed, F.col("revenue"))).alias("revenue_without_cost"),
        total(F.when(~costed, F.col("quantity"))).alias("units_without_cost"),
    ]


def by_locale(name: str = "sku") -> list[Column]:
    """A text in the order of a reader, not of its bytes; what that holds equal by bytes."""
    return [F.collate(name, "UNICODE"), F.col(name)]


def closed(rows: DataFrame) -> DataFrame:
    """Adds margin and margin_pct from the sums; subtracted as decimals, which keep a margin that ends in half a cent."""
    rows = rows.withColumn("margin", (exact("revenue") - exact("marketplace_fee") - exact("shipping_fee") - exact("cost")).cast("double"))
    return rows.withColumn("margin_pct", percent_of("margin", "revenue"))


def margin_sets(lines: DataFrame) -> DataFrame:
    """Sums by SKU and over everything in one pass: is_total, sku, label, measures, margin, margin_pct."""
    costed = F.col("unit_cost").isNotNull()
    rows = lines.rollup("sku").agg(F.grouping("sku").cast("boolean").alias("is_total"), shortest_title().alias("label"), *_measures(costed), F.count_if(costed).alias("costed_lines"))
    return closed(rows)


def margin_by_sku(lines: DataFrame) -> DataFrame:
    """SKUs with known costs, best margin first."""
    costed = F.col("unit_cost").isNotNull()
    rows = closed(lines.where(costed).groupBy("sku").agg(shortest_title().alias("label"), *_measures(F.lit(True))))
    return rows.drop("revenue_without_cost", "units_without_cost").orderBy(F.desc("margin"), *by_locale())


def margin_total(lines: DataFrame) -> DataFrame:
    """One row: the sums, without_cost (share of revenue), real_freight (share), available; money is null if unavailable."""
    costed = F.col("unit_cost").isNotNull()
    rows = closed(lines.agg(*_measures(costed), F.count(F.lit(1)).alias("lines")))
    # Compared as decimals: a share of exactly a fifth is still available.
    limit = F.col("revenue_without_cost").cast("decimal(28,4)") * 10 <= (F.col("revenue") + F.col("revenue_without_cost")).cast("decimal(28,4)") * int(MOST_WITHOUT_COST * 10)
    rows = rows.withColumns(
        {
            "without_cost": F.coalesce(F.try_divide(F.col("revenue_without_cost"), F.col("revenue") + F.col("revenue_without_cost")), F.lit(0.0)),
            "real_freight": F.coalesce(F.try_divide("revenue_real_freight", "revenue"), F.lit(0.0)),
            "available": limit,
        }
    )
    money = ("revenue", "marketplace_fee", "shipping_fee", "cost", "units", "freight_real", "freight_estimated", "margin", "margin_pct", "real_freight")
    rows = rows.withColumns({c: F.when(F.col("available"), F.col(c)) for c in money})
    return rows.withColumn("warnings", margin_warnings()).drop("lines", "revenue_real_freight")


def margin_warnings() -> Column:
    partly = F.when(~F.col("available"), "custo_insuficiente").when(F.col("revenue_without_cost") > 0, "custo_parcial")
    found = F.array(
        F.lit("antes_de_publicidade"), partly, F.when(F.col("available") & (F.col("freight_estimated") > 0), "frete_estimado"), F.when(F.col("lines") == 0, "sem_dados_no_periodo")
    )
    return F.array_join(F.array_compact(found), ",")


def without_cost_titles(lines: DataFrame) -> DataFrame:
    """title, revenue, units of lines whose cost is unknown; by title."""
    rows = lines.where(F.col("unit_cost").isNull() & F.coalesce(F.col("title") != "", F.lit(False)))
    return rows.groupBy("title").agg(total("revenue").alias("revenue"), total("quantity").alias("units")).orderBy("title")


def best_margins(by_sku: DataFrame, n: int = 5) -> DataFrame:
    return by_sku.orderBy(F.desc("margin"), *by_locale()).limit(max(0, n))


def worst_margins(by_sku: DataFrame, n: int = 5) -> DataFrame:
    return by_sku.orderBy("margin", *[c.desc() for c in by_locale()]).limit(max(0, n))
