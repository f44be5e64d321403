"""The dashboard: fixed windows and groupings of one snapshot."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import is_sale, or_else, total
from tideline.functions.dates import in_period, with_civil_date
from tideline.functions.places import kept
from tideline.operators import sales
from tideline.operators.costs import Fees

REPUTATION_DAYS, STOCK_DAYS = 60, 30


def fixed_windows(today: date, oldest: date | None, newest: date | None) -> dict[str, tuple[date, date]]:
    """Today; seven days up to today; the month so far; all there is."""
    out = {"hoje": (today, today), "ultimos7": (today - timedelta(days=6), today), "mesAtual": (today.replace(day=1), today)}
    if oldest and newest:
        out["historico"] = (oldest, newest)
    return out


def dashboard_rows(orders: DataFrame, period: tuple[date, date], today: date, oldest: date | None, newest: date | None) -> DataFrame:
    """part, key, orders, units, amount: every part of the dashboard, from one pass over the orders.

    Each order says what it adds to each part, and all parts are summed by (part, key) at once:
    windows (paid amount, units), period and reputation (gross), item (first items of the
    period), stock (units of every line of the last days), month (of the date's text), status
    (all orders). What an order adds is a short list, so the rows between are a few times the
    orders, and partial sums shrink them before the only shuffle.
    """
    o = with_civil_date(orders)
    day, sale = F.col("civil_date"), is_sale()
    inside = lambda a, b: sale & in_period(day, a, b)
    back = lambda n: (today - timedelta(days=n), today)
    none = F.lit(None).cast("double")

    def adds(part: str, key: Column, where: Column, units: Column, amount: Column) -> Column:
        row = F.struct(F.lit(part).alias("part"), key.cast("string").alias("key"), units.cast("double").alias("units"), amount.cast("double").alias("amount"))
        return F.when(F.coalesce(where, F.lit(False)), row)

    first, month = sales.first_line(o), F.substring("date_created", 1, 7)
    units = sales.units_of_order(o)
    parts = [adds("window", F.lit(n), inside(a, b), units, sales.paid()) for n, (a, b) in fixed_windows(today, oldest, newest).items()]
    parts += [
        adds("period", F.lit("total"), inside(*period), none, sales.gross()),
        adds("item", first["item"]["id"], inside(*period) & (first["item"]["id"] != ""), or_else(first["quantity"], F.lit(1.0)), sales.paid()),
        adds("reputation", F.lit("total"), inside(*back(REPUTATION_DAYS)), none, sales.gross()),
        adds("month", month, sale & (month != ""), none, sales.paid()),
        adds("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("desconhecido")), F.coalesce(F.col("status") != "cancelled", F.lit(True)), none, none),
    ]
    line = lambda x: F.struct(F.lit("stock").alias("part"), x["item"]["id"].cast("string").alias("key"), or_else(x["quantity"], F.lit(1.0)).cast("double").alias("units"), none.alias("amount"))
    sold = F.transform(F.filter("order_items", lambda x: F.coalesce(x["item"]["id"] != "", F.lit(False))), line)
    stock = F.when(inside(*back(STOCK_DAYS)), sold)
    rows = o.select(F.explode(F.concat(F.array_compact(F.array(*parts)), F.coalesce(stock, F.array().cast("array<struct<part:string,key:string,units:double,amount:double>>")))).alias("x")).select("x.*")
    return rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("orders"), total("units").alias("units"), total("amount").alias("amount"))


def dashboard(orders: DataFrame, period: tuple[date, date], today: date, oldest: date | None, newest: date | None, fees: Fees = Fees()) -> dict[str, DataFrame]:
    """All parts by name. Their sums are found once, in one pass, and kept; each part is a filter on them, in its own order."""
    sums = kept(dashboard_rows(orders, period, today, oldest, newest))
    part = lambda name, *columns: sums.where(F.col("part") == name).select(*columns)
    money = {"marketplace_fee": -F.col("gross") * fees.marketplace, "shipping_fee": -F.col("gross") * fees.shipping}
    gross = lambda name: sums.where(F.col("part") == name).agg(total("amount").alias("gross")).withColumns(money).withColumn("net", F.col("gross") + F.col("marketplace_fee") + F.col("shipping_fee")).withColumn("estimated", F.lit(True))
    names = orders.sparkSession.createDataFrame([(n,) for n in fixed_windows(today, oldest, newest)], "window string")
    windows = names.join(part("window", F.col("key").alias("window"), F.col("amount").alias("revenue"), "orders", "units"), "window", "left").fillna(0.0, ["revenue", "units"]).fillna(0, ["orders"])
    by_text = F.collate("item_id", "UNICODE")
    return {
        "windows": windows.withColumn("average_ticket", F.try_divide("revenue", F.col("orders").cast("double"))),
        "period": gross("period"),
        "by_item": part("item", F.col("key").alias("item_id"), "orders", "units", F.col("amount").alias("revenue")).orderBy(F.desc("revenue"), by_text, "item_id"),
        "reputation": gross("reputation"),
        "stock_units": part("stock", F.col("key").alias("item_id"), "units").orderBy(F.desc("units"), by_text, "item_id"),
        "by_month": part("month", F.col("key").alias("month"), F.col("amount").alias("revenue")).orderBy("month"),
        "by_status": part("status", F.col("key").alias("status"), "orders").orderBy("status"),
    }
