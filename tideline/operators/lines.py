"""Order lines: exploded, joined with shipments, and given their share of the freight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import blank_to_null, is_sale, line_sku, shipment_id, total
from tideline.functions.dates import with_civil_date


def first_seen(orders: DataFrame) -> DataFrame:
    """One row per id: the one that arrived first. Orders without ordinal have no arrival order."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_last("ordinal")))
    return orders.withColumn("__n", rank).where("__n = 1").drop("__n")


def order_lines(orders: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per line with position; keep_empty gives orders without lines a row without item."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    o = with_civil_date(orders)
    arrival = F.col("ordinal") if "ordinal" in o.columns else F.lit(None).cast("long").alias("ordinal")
    o = o.select("id", arrival, "status", "civil_date", "date_created", "buyer", "shipping", explode("order_items").alias("pos", "line"))
    return o.select(
        F.col("id").alias("order_id"),
        "ordinal",
        "pos",
        "status",
        "civil_date",
        "date_created",
        F.col("buyer.nickname").alias("buyer"),
        shipment_id("shipping.id").alias("shipment_id"),
        blank_to_null("shipping.logistic_type").alias("own_logistic_type"),
        F.col("line.item.id").alias("item_id"),
        F.col("line.item.title").alias("title"),
        F.col("line.item.seller_sku").alias("seller_sku"),
        F.col("line.quantity").alias("quantity"),
        F.col("line.unit_price").alias("unit_price"),
    )


def shared_key(shipment: Column, order_id: Column | None = None) -> Column:
    """What lines and shipments are dealt by: the shipment, or the order where there is none."""
    own = F.concat(F.lit("ship:"), shipment)
    return own if order_id is None else F.coalesce(own, F.concat(F.lit("order:"), order_id))


def with_shipments(lines: DataFrame, shipments: DataFrame) -> DataFrame:
    """Adds logistic_type (the order's own, else the shipment's) and freight (null: unknown, 0: free) to lines with __key.

    A plain equi-join: both sides may be of any size, and a shipment holds few lines. Lines lie
    by __key already (shipment_totals), so beyond the size of a broadcast only shipments move.
    """
    ship = shipments.select(shared_key(F.col("shipment_id")).alias("__ship"), F.col("logistic_type").alias("__type"), F.col("custo_frete").alias("freight"))
    held = lines.join(ship, lines["__key"] == ship["__ship"], "left")
    return held.withColumn("logistic_type", F.coalesce("own_logistic_type", "__type")).drop("__ship", "__type", "own_logistic_type", "__key")


def shipment_totals(sale_lines: DataFrame) -> DataFrame:
    """Adds ship_revenue and ship_units over all sale lines of a shipment, whatever the period, and __key.

    Lines without shipment are dealt by order, so they never meet in one partition.
    """
    q, p = F.coalesce("quantity", F.lit(1.0)), F.coalesce("unit_price", F.lit(0.0))
    own = Window.partitionBy("__key")
    held = sale_lines.withColumn("__key", shared_key(F.col("shipment_id"), F.col("order_id")))
    added = lambda x: F.sum(F.greatest(F.lit(0.0), x).cast("decimal(28,8)")).over(own).cast("double")
    return held.withColumns({"ship_revenue": added(q * p), "ship_units": added(q)})


def freight_share(freight: Column, revenue: Column, quantity: Column, ship_revenue: Column, ship_units: Column) -> Column:
    """A line's part of its shipment's cost: by revenue, else by units, else 0; null if the cost is unknown."""
    by_revenue = freight * F.try_divide(F.greatest(F.lit(0.0), revenue), ship_revenue)
    by_units = freight * F.try_divide(F.greatest(F.lit(0.0), quantity), ship_units)
    return F.when(freight.isNull(), None).when(freight == 0, 0.0).when(ship_revenue > 0, by_revenue).when(ship_units > 0, by_units).otherwise(0.0)


def as_lines(orders: DataFrame) -> DataFrame:
    """Sale lines of orders, or of rows that are lines already."""
    return orders.where(is_sale()) if "order_id" in orders.columns else order_lines(orders.where(is_sale()))


def sale_lines(orders: DataFrame, shipments: DataFrame, cut: Column | None = None) -> DataFrame:
    """The sale lines that cut leaves (all by default) with revenue, sku, logistics and freight share.

    Freight is shared over all of a shipment's sales, so cut (a period: whole orders) comes after
    that, and before anything else is done to lines. first_of_order marks one line of each SKU in
    an order, so orders are counted by a sum. Lines of an order lie in one partition by shipment,
    so the mark costs a sort and no shuffle.
    """
    lines = shipment_totals(as_lines(orders))
    lines = lines.withColumn("sku", line_sku("seller_sku", "item_id")) if cut is None else lines.where(cut).withColumn("sku", line_sku("seller_sku", "item_id"))
    order = Window.partitionBy("__key", "order_id", "sku").orderBy("pos")
    lines = lines.withColumn("first_of_order", F.row_number().over(order) == 1)
    lines = with_shipments(lines, shipments)
    lines = lines.withColumns({"quantity": F.coalesce("quantity", F.lit(1.0)), "unit_price": F.coalesce("unit_price", F.lit(0.0))})
    lines = lines.withColumn("revenue", F.col("unit_price") * F.col("quantity"))
    share = F.when(F.col("shipment_id").isNotNull(), freight_share(*[F.col(c) for c in ("freight", "revenue", "quantity", "ship_revenue", "ship_units")]))
    return lines.withColumn("freight_share", share)


def shipment_base(orders: DataFrame) -> DataFrame:
    """shipment_id, revenue, units: what freight is shared by."""
    lines = as_lines(orders).where(F.col("shipment_id").isNotNull())
    q, p = F.coalesce("quantity", F.lit(1.0)), F.coalesce("unit_price", F.lit(0.0))
    return lines.groupBy("shipment_id").agg(total(F.greatest(F.lit(0.0), q * p)).alias("revenue"), total(F.greatest(F.lit(0.0), q)).alias("units"))
