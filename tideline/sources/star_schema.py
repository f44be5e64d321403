"""Orders, shipments, listings and rules made from star-schema tables.

orders() nests them as the engine stores them; one shuffle by order key nests the lines.
order_lines() and order_facts() are the same sales at the grain of lines and of orders, for
operators that need no nesting: filters on orders then reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.costs import CostRule, with_rules

RULES = (
    CostRule(1, "brand_low", 310.0, match=("zzz",), sku=("Brand#1", "Brand#2", "Brand#3", "Brand#4")),
    CostRule(2, "brand_high", 540.0, match=("zzz",), sku=("Brand#4", "Brand#20", "Brand#21")),
    CostRule(3, "widget_steel", 420.0, match=("widget",), tipo=("steel", "economy", "small")),
    CostRule(4, "gear", 365.5, match=("Gear", "gadget"), exclui=("promo",)),
    CostRule(5, "widget", 398.25, match=("Wídget",)),
    CostRule(6, "bolt", 120.0, match=("bolt", "cog"), exclui=("large",)),
)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def order_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without lines; order days count as wall-clock days of the seller."""
    o = read(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "P", "partially_refunded").otherwise("cancelled")
    ship = (F.col("o_orderkey") - F.col("o_orderkey") % 2) / 2
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        status.alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'-03:00'").alias("date_created"),
        F.col("o_orderdate").cast("date").alias("civil_date"),
        F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("paid_amount"),
        F.col("o_totalprice").alias("total_amount"),
        F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nickname")).alias("buyer"),
        F.struct(ship.cast("long").cast("string").alias("id"), F.lit(None).cast("string").alias("logistic_type")).alias("shipping"),
        F.col("o_orderkey").alias("ordinal"),
        F.struct(F.substring_index("o_orderpriority", "-", -1).alias("group"), F.lit(None).cast("string").alias("code"), F.col("o_orderpriority").alias("description")).alias("cancel_detail"),
    )


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """p_partkey and what a line says of its item: item_id, title, seller_sku."""
    k = F.col("p_partkey")
    return read(spark, folder, "part").select(
        k, F.concat(F.lit("P"), k.cast("string")).alias("item_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.when(k % 17 != 0, F.col("p_brand")).alias("seller_sku")
    )


def rule_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table of cost rules that grows with the parts: terms of their names and sizes, some with kinds, exclusions or a SKU."""
    k = F.col("p_partkey")
    first, last = F.get(F.split("p_name", " "), F.lit(0)), F.element_at(F.split("p_name", " "), -1)
    some = lambda when, text: F.when(when, F.array(text)).otherwise(F.array().cast("array<string>"))
    return read(spark, folder, "part").select(
        k.cast("int").alias("ordem"),
        F.concat(F.lit("R"), k.cast("string")).alias("id"),
        (F.lit(100.0) + k % 50).alias("custo_produto"),
        some(k % 97 == 0, F.col("p_brand")).alias("sku"),
        F.array(F.concat(last, F.lit(" "), F.upper("p_type")), F.concat(F.lit("#"), k.cast("string"))).alias("match"),
        some(k % 3 != 0, first).alias("tipo"),
        some(k % 5 != 0, F.substring("p_name", 2, 3)).alias("exclui"),
    )


def order_lines(spark: SparkSession, folder: str, rules=None) -> DataFrame:
    """One row per line, with the columns of operators.lines.order_lines; with rules also each item's cost rule.

    Rules are found once for each part, before lines meet them. Lines meet orders first, while
    they are narrow: filters on orders then leave few of them to be moved with their titles.
    """
    items = parts(spark, folder) if rules is None else with_rules(parts(spark, folder), rules)
    heads = order_heads(spark, folder).select("ordinal", F.col("id").alias("order_id"), "status", "civil_date", "date_created", F.col("buyer.nickname").alias("buyer"), F.col("shipping.id").alias("shipment_id"))
    line = read(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", (F.col("l_linenumber") - 1).cast("int").alias("pos"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price")
    )
    held = line.join(heads, F.col("l_orderkey") == F.col("ordinal")).join(items, F.col("l_partkey") == F.col("p_partkey"))
    return held.select(
        "order_id", "ordinal", "pos", "status", "civil_date", "date_created", "buyer", "shipment_id", F.lit(None).cast("string").alias("own_logistic_type"), "item_id", "title", "seller_sku", "quantity", "unit_price",
        *items.columns[4:],
    )


def order_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without lines, but with what their lines come to: units, and first_item (item, quantity).

    Lines are added up by order key where they stand, so little of them is shuffled.
    """
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("f")
    of_lines = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("units"), first)
    item = F.struct(F.concat(F.lit("P"), F.col("f.l_partkey").cast("string")).alias("id"))
    of_lines = of_lines.select("l_orderkey", "units", F.struct(item.alias("item"), F.col("f.l_quantity").alias("quantity")).alias("first_item"))
    heads = order_heads(spark, folder)
    return heads.join(of_lines, heads["ordinal"] == of_lines["l_orderkey"], "left").drop("l_orderkey").withColumn("units", F.coalesce("units", F.lit(0.0)))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their lines; an order without lines has an empty list."""
    p = read(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    line = F.struct(
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.struct(
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("id"),
            F.concat_ws(" ", "p_name", "p_type").alias("title"),
            F.when(F.col("l_partkey") % 17 != 0, F.col("p_brand")).alias("seller_sku"),
            F.lit(None).cast("string").alias("variation_id"),
        ).alias("item"),
    )
    lines = read(spark, folder, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("all"))
    plain = F.transform("all", lambda x: F.struct(x["quantity"].alias("quantity"), x["unit_price"].alias("unit_price"), x["item"].alias("item")))
    lines = lines.select("id", plain.alias("order_items"))
    heads = order_heads(spark, folder).join(lines, "id", "left")
    return heads.withColumn("order_items", F.coalesce("order_items", F.array().cast(lines.schema["order_items"].dataType)))


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders").select(((F.col("o_orderkey") - F.col("o_orderkey") % 2) / 2).cast("long").alias("s")).distinct()
    kinds = F.array(*[F.lit(x) for x in ("fulfillment", "cross_docking", "drop_off", "self_service", "xd_drop_off")])
    cost = F.when(F.col("s") % 7 == 0, F.lit(None)).when(F.col("s") % 11 == 0, 0.0).otherwise((5 + F.col("s") % 40).cast("double"))
    return o.select(F.col("s").cast("string").alias("shipment_id"), F.get(kinds, (F.col("s") % 5).cast("int")).alias("logistic_type"), cost.alias("custo_frete"))


def listings(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    return read(spark, folder, "part").select(
        F.concat(F.lit("P"), text(k)).alias("id"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.get(F.array(F.lit("active"), F.lit("paused"), F.lit("closed")), F.col("p_size") % 3).alias("status"),
        F.col("p_retailprice").alias("price"),
        none.cast("double").alias("original_price"),
        (F.col("p_size") - 3).cast("double").alias("available_quantity"),
        (k % 9).cast("double").alias("sold_quantity"),
        F.when(k % 2 == 0, "gold_pro").otherwise("gold_special").alias("listing_type_id"),
        F.lit(False).alias("catalog_listing"),
        F.when(k % 4 != 0, F.concat(F.lit("INV"), text((k - k % 3).cast("long")))).alias("inventory_id"),
        none.alias("permalink"),
        none.alias("thumbnail"),
        none.alias("last_updated"),
        F.when(k % 17 != 0, F.col("p_brand")).alias("seller_custom_field"),
        none.alias("seller_sku"),
        F.array().cast("array<string>").alias("tags"),
        F.struct(F.when(k % 5 < 2, "fulfillment").otherwise("drop_off").alias("logistic_type")).alias("shipping"),
        F.array().cast("array<struct<id:string,value_name:string>>").alias("attributes"),
        k.alias("ordinal"),
    )


def sku_map(spark: SparkSession, folder: str) -> DataFrame:
    """Item to SKU; parts without a brand code have no row."""
    k = F.col("p_partkey")
    return read(spark, folder, "part").where(k % 17 != 0).select(F.concat(F.lit("P"), k.cast("string")).alias("item_id"), F.col("p_brand").alias("sku"))


def refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """A later batch of orders: some changed, some new, some as before."""
    o = order_heads(spark, folder).drop("cancel_detail")
    k = F.col("ordinal")
    changed = o.where(k % 20 == 0).withColumn("total_amount", F.col("total_amount") + F.when(k % 40 == 0, 10.0).otherwise(0.0))
    new = o.where(k % 50 == 1).withColumn("id", F.concat(F.lit("N"), "id"))
    return changed.unionByName(new)
