"""Sales: sums and groupings over nested orders.

Each function states its own fallback for missing and zero values; they differ on purpose.
Revenue comes in three kinds: paid, gross (paid, else the order's total), and products
(price by quantity). An order without lines still counts as an order, so orders are
counted at their own grain and never after an explode.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import is_sale, or_else, percent_change, total
from tideline.functions.dates import in_optional_period, in_period, instant, with_civil_date
from tideline.operators.costs import Fees
from tideline.operators.lines import as_lines


def paid() -> Column:
    return or_else("paid_amount", F.lit(0.0))


def gross() -> Column:
    return or_else("paid_amount", or_else("total_amount", F.lit(0.0)))


def units_of_order(orders: DataFrame) -> Column:
    """The units of an order's lines, or those that stand in units."""
    if "units" in orders.columns:
        return F.col("units")
    return F.coalesce(F.aggregate("order_items", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["quantity"], F.lit(1.0))), F.lit(0.0))


def first_line(orders: DataFrame) -> Column:
    """The first of an order's lines, or what stands in first_item."""
    return F.col("first_item") if "first_item" in orders.columns else F.get("order_items", F.lit(0))


def sales_in(orders: DataFrame, start: date | None, end: date | None) -> DataFrame:
    return with_civil_date(orders.where(is_sale())).where(in_period("civil_date", start, end))


def sales_summary(orders: DataFrame, start: date, end: date) -> DataFrame:
    """One row: revenue (paid), orders, units, average_ticket (null without orders)."""
    rows = sales_in(orders, start, end).agg(total(paid()).alias("revenue"), F.count(F.lit(1)).alias("orders"), total(units_of_order(orders)).alias("units"))
    return rows.withColumn("average_ticket", F.try_divide("revenue", F.col("orders").cast("double")))


def windows_summary(orders: DataFrame, windows: dict[str, tuple[date, date]]) -> DataFrame:
    """One row per named window, all from a single scan: window, revenue, orders, units, average_ticket."""
    rows = with_civil_date(orders.where(is_sale())).where(F.col("civil_date").isNotNull())
    spans = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in windows.items()])
    inside = F.filter(spans, lambda w: F.col("civil_date").between(w["a"], w["b"]))
    rows = rows.select(paid().alias("p"), units_of_order(orders).alias("u"), F.explode(inside).alias("w"))
    found = rows.groupBy(F.col("w.window").alias("window")).agg(total("p").alias("revenue"), F.count(F.lit(1)).alias("orders"), total("u").alias("units"))
    names = orders.sparkSession.createDataFrame([(n,) for n in windows], "window string")
    out = names.join(found, "window", "left").fillna(0.0, ["revenue", "units"]).fillna(0, ["orders"])
    return out.withColumn("average_ticket", F.try_divide("revenue", F.col("orders").cast("double")))


def compare_periods(orders: DataFrame, now: tuple[date, date], before: tuple[date, date]) -> DataFrame:
    """Both periods' summaries in one scan, and the change of each in percent (null from 0)."""
    rows = with_civil_date(orders.where(is_sale()))
    inside = {"now": in_period("civil_date", *now), "before": in_period("civil_date", *before)}
    rows = rows.where(inside["now"] | inside["before"])
    aggs = []
    for n, c in inside.items():
        aggs += [total(F.when(c, paid())).alias(f"revenue_{n}"), F.count_if(c).alias(f"orders_{n}"), total(F.when(c, units_of_order(orders))).alias(f"units_{n}")]
    out = rows.agg(*aggs)
    for n in inside:
        out = out.withColumn(f"ticket_{n}", F.try_divide(f"revenue_{n}", F.col(f"orders_{n}").cast("double")))
    changes = {f"{m}_change": percent_change(F.col(f"{m}_now").cast("double"), F.col(f"{m}_before").cast("double")) for m in ("revenue", "orders", "units", "ticket")}
    return out.withColumns(changes)


def gross_and_net(orders: DataFrame, start: date | None, end: date | None, fees: Fees = Fees()) -> DataFrame:
    """One row: gross, marketplace_fee, shipping_fee (both negative), net; an estimate by fixed rates."""
    rows = sales_in(orders, start, end).agg(total(gross()).alias("gross"))
    rows = rows.withColumns({"marketplace_fee": -F.col("gross") * fees.marketplace, "shipping_fee": -F.col("gross") * fees.shipping})
    return rows.withColumns({"net": F.col("gross") + F.col("marketplace_fee") + F.col("shipping_fee"), "estimated": F.lit(True)})


def sales_by_first_item(orders: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """item_id, orders, units, revenue: the whole order's amount goes to its first item."""
    first = first_line(orders)
    rows = with_civil_date(orders.where(is_sale())).where(in_optional_period("civil_date", start, end))
    rows = rows.select(first["item"]["id"].alias("item_id"), or_else(first["quantity"], F.lit(1.0)).alias("q"), paid().alias("p"))
    rows = rows.where(F.coalesce(F.col("item_id") != "", F.lit(False)))
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("orders"), total("q").alias("units"), total("p").alias("revenue"))


def _sku_lines(orders: DataFrame, sku_map: DataFrame, start: date | None, end: date | None) -> DataFrame:
    lines = as_lines(orders).where(in_optional_period("civil_date", start, end))
    codes = sku_map.select("item_id", F.col("sku").alias("map_sku"))
    # Orders may be repeated; lines that are given as such are not.
    lines = lines if "order_id" in orders.columns else lines.dropDuplicates(["order_id", "item_id", "pos"])
    return lines.join(codes, "item_id")


def sku_detail(orders: DataFrame, sku_map: DataFrame, sku: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """One row per line of a SKU, sorted by date, order and item."""
    lines = _sku_lines(orders, sku_map.where(F.col("sku") == sku), start, end)
    q, p = or_else("quantity", F.lit(1.0)), or_else("unit_price", F.lit(0.0))
    out = lines.select(
        "order_id",
        "item_id",
        F.col("map_sku").alias("sku"),
        F.col("date_created").alias("date"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit("-")).alias("title"),
        p.alias("unit_price"),
        q.alias("quantity"),
        (p * q).alias("amount"),
        "status",
        F.coalesce(F.nullif("buyer", F.lit("")), F.lit("-")).alias("buyer"),
    )
    return out.orderBy("date", F.collate("order_id", "UNICODE"), F.collate("item_id", "UNICODE"))


def sales_by_sku(orders: DataFrame, sku_map: DataFrame, start: date | None = None, end: date | None = None, week_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """sku, units, revenue, by_week (week to units). week_of: from a civil date to a week number; 1 by default."""
    week = F.lit(1) if week_of is None else week_of(F.col("civil_date")).cast("int")
    q, p = or_else("quantity", F.lit(1.0)), or_else("unit_price", F.lit(0.0))
    weekly = _sku_lines(orders, sku_map, start, end).groupBy(F.col("map_sku").alias("sku"), week.alias("week")).agg(total(q).alias("u"), F.sum((p * q).cast("decimal(28,8)")).alias("r"))
    by_week = F.map_from_entries(F.sort_array(F.collect_list(F.struct("week", "u")))).alias("by_week")
    return weekly.groupBy("sku").agg(total("u").alias("units"), total("r").alias("revenue"), by_week)


def revenue_by_text_month(orders: DataFrame) -> DataFrame:
    """month (the first seven characters of the date's text), revenue; by month."""
    month = F.substring("date_created", 1, 7)
    rows = orders.where(is_sale()).where(F.coalesce(month != "", F.lit(False)))
    return rows.groupBy(month.alias("month")).agg(total(paid()).alias("revenue")).orderBy("month")


def revenue_by_day(orders: DataFrame, year: int, month: int) -> DataFrame:
    """day, revenue (gross) of one civil month."""
    start = date(year, month, 1)
    end = date(year + month // 12, month % 12 + 1, 1)
    rows = with_civil_date(orders.where(is_sale())).where((F.col("civil_date") >= F.lit(start)) & (F.col("civil_date") < F.lit(end)))
    return rows.groupBy(F.dayofmonth("civil_date").alias("day")).agg(total(gross()).alias("revenue"))


def cancel_reasons(cancelled: DataFrame, labels: DataFrame | Callable[[Column], Column] | None = None) -> DataFrame:
    """group, code, orders, amount, description (of the first order seen); most frequent first.

    labels: a table of code and label, or a function from the code to its label; where they have
    none, or an empty one, the description stays. All orders given count, whatever their status.
    """
    group = F.coalesce(F.nullif("cancel_detail.group", F.lit("")), F.lit("desconhecido"))
    code = F.coalesce(F.nullif("cancel_detail.code", F.lit("")), F.lit("sem_detalhe"))
    rows = cancelled.select(group.alias("group"), code.alias("code"), F.nullif("cancel_detail.description", F.lit("")).alias("text"), "total_amount", "ordinal", "id")
    out = rows.groupBy("group", "code").agg(
        F.count(F.lit(1)).alias("orders"),
        total(or_else("total_amount", F.lit(0.0))).alias("amount"),
        F.min(F.struct(F.col("ordinal").isNull().alias("late"), "ordinal", "id", "text")).alias("first"),
    )
    text = F.coalesce("first.text", F.lit("Sem descricao"))
    if callable(labels):
        text = F.coalesce(F.nullif(labels(F.col("code")), F.lit("")), text)
    elif labels is not None:
        # One row per group and code is left here, so the join is small.
        out = out.join(labels.select("code", "label").dropDuplicates(["code"]), "code", "left")
        text = F.coalesce(F.nullif("label", F.lit("")), text)
    out = out.select("group", "code", "orders", "amount", text.alias("description"))
    return out.orderBy(F.desc("orders"), F.concat_ws("::", "group", "code"))


def units_by_item(orders: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """item_id, units over all lines."""
    lines = as_lines(orders).where(in_optional_period("civil_date", start, end))
    lines = lines.where(F.coalesce(F.col("item_id") != "", F.lit(False)))
    return lines.groupBy("item_id").agg(total(or_else("quantity", F.lit(1.0))).alias("units"))


def status_counts(orders: DataFrame) -> DataFrame:
    """status, orders of all orders."""
    return orders.groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("desconhecido")).alias("status")).agg(F.count(F.lit(1)).alias("orders"))


def date_bounds(orders: DataFrame) -> DataFrame:
    """One row: oldest and newest date text (compared as text), and the same by instant. Each text is read once, however many orders have it."""
    dated = orders.where(F.coalesce(F.col("date_created") != "", F.lit(False))).select("date_created").distinct()
    moment = instant("date_created")
    return dated.agg(
        F.min("date_created").alias("oldest_date"),
        F.max("date_created").alias("newest_date"),
        F.min_by("date_created", moment).alias("oldest_by_instant"),
        F.max_by("date_created", moment).alias("newest_by_instant"),
    )
