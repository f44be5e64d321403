"""Listings: projection, counts, and the consolidated view by SKU."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import is_sale, item_sku, or_else, total
from tideline.operators.margin import by_locale
from tideline.operators.sales import first_line, gross
from tideline.operators.stock import consolidate, stock_lines


def slim_listings(raw: DataFrame) -> DataFrame:
    """The kept fields of listings; rows without id go, numbers that aren't finite become null, one SKU attribute stays."""
    number = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c)
    numbers = ("price", "original_price", "available_quantity", "sold_quantity")
    texts = ("id", "title", "status", "listing_type_id", "inventory_id", "permalink", "thumbnail", "last_updated", "seller_custom_field", "seller_sku")
    own = F.slice(F.filter("attributes", lambda a: a["id"] == "SELLER_SKU"), 1, 1)
    tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull())
    return raw.where(F.coalesce(F.col("id") != "", F.lit(False))).select(
        *texts, *[number(c) for c in numbers], "catalog_listing", tags.alias("tags"), "shipping", F.coalesce(own, F.slice("attributes", 1, 0)).alias("attributes"), "ordinal"
    )


def catalog_counts(listings: DataFrame) -> DataFrame:
    """One row: total, active, paused, closed."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return listings.agg(F.count(F.lit(1)).alias("total"), of("active"), of("paused"), of("closed"))


def consolidated(listings: DataFrame, orders: DataFrame, stock: DataFrame | None = None, stock_of: Callable[[], Column] | None = None) -> DataFrame:
    """One row per SKU: label, listings, sold, orders by first item, average prices, units, stock.

    Orders meet listings at item grain after they are summed by item, so both joins are
    between aggregates. stock: sku, total; by default the consolidated stock. stock_of: in its
    place an aggregate over the listings of a group, found in the pass that finds the others.
    """
    sku = F.coalesce(item_sku("seller_custom_field", "attributes", "seller_sku"), F.concat(F.lit("sem-sku-"), F.coalesce("id", F.lit("desconhecido"))))
    first = first_line(orders)
    by_item = orders.where(is_sale()).select(first["item"]["id"].alias("id"), gross().alias("g"), or_else(first["quantity"], F.lit(1.0)).alias("q"))
    by_item = by_item.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("orders"), total("g").alias("gross"), total("q").alias("units"))
    rows = listings.withColumn("sku", sku).join(by_item, "id", "left")
    priced = (F.col("status") == "active") & (F.col("price") > 0)
    short = F.min(F.when(F.col("title") != "", F.struct(F.length("title").alias("l"), "ordinal", "title")))["title"]
    out = rows.groupBy("sku").agg(
        short.alias("label"),
        F.count(F.lit(1)).alias("listings"),
        total(F.coalesce("sold_quantity", F.lit(0.0))).alias("sold"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        F.coalesce(F.try_divide(total(F.when(priced, F.col("price"))), F.count_if(priced).cast("double")), F.lit(0.0)).alias("average_listing_price"),
        total("gross").alias("gross"),
        total("units").alias("units"),
        *([stock_of().alias("stock")] if stock_of else []),
    )
    out = out.withColumn("average_sold_price", F.coalesce(F.try_divide("gross", "units"), F.lit(0.0))).drop("gross")
    if stock_of is None:
        held = consolidate(stock_lines(listings)).select("sku", "total") if stock is None else stock.select("sku", "total")
        out = out.join(held.withColumnRenamed("total", "stock"), "sku", "left")
    return out.orderBy(F.desc("orders"), F.desc("sold"), *by_locale())
