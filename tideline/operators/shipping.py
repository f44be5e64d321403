"""Shipments: what is known, what is missing, and how new facts are merged in."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import blank_to_null, is_sale, shipment_id
from tideline.functions.places import numbered

DEFAULT_BATCH, MAX_BATCH = 300, 1000


def clean_cost(cost: str = "custo_frete"):
    """A cost that isn't finite or is negative is unknown; 0 is free."""
    return F.when((F.col(cost) >= 0) & (F.col(cost) < float("inf")), F.col(cost))


def sale_shipments(orders: DataFrame) -> DataFrame:
    """shipment_id, newest (the latest date text) of all sales' shipments."""
    rows = orders.where(is_sale()).select(shipment_id("shipping.id").alias("shipment_id"), F.coalesce("date_created", F.lit("")).alias("d"))
    return rows.where(F.col("shipment_id").isNotNull()).groupBy("shipment_id").agg(F.max("d").alias("newest"))


def resolved(shipments: DataFrame) -> DataFrame:
    """Shipments whose cost is known."""
    return shipments.where(clean_cost().isNotNull())


def batch_size(limit: float) -> int:
    return DEFAULT_BATCH if not math.isfinite(limit) else max(0, min(MAX_BATCH, math.floor(limit)))


def pending_shipments(orders: DataFrame, shipments: DataFrame, limit: float | None = DEFAULT_BATCH) -> DataFrame:
    """shipment_id, newest of sales' shipments not resolved yet, newest first, dates missing last; limit None gives all."""
    rows = sale_shipments(orders).join(resolved(shipments).select("shipment_id"), "shipment_id", "left_anti")
    rows = rows.orderBy((F.col("newest") == ""), F.desc("newest"), "shipment_id")
    return rows if limit is None else rows.limit(batch_size(limit))


def pending_counts(orders: DataFrame, shipments: DataFrame, limit: float = DEFAULT_BATCH) -> DataFrame:
    """One row: shipments, resolved, batch (pending ones of the next batch), remaining (those after it)."""
    rows = freight_coverage(orders, shipments)
    n = F.lit(batch_size(limit)).cast("long")
    return rows.select("shipments", "resolved", F.least("pending", n).alias("batch"), F.greatest(F.lit(0).cast("long"), F.col("pending") - n).alias("remaining"))


def freight_coverage(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """One row: shipments, resolved, pending, fraction (1 without shipments)."""
    known = resolved(shipments).select("shipment_id", F.lit(True).alias("known"))
    rows = sale_shipments(orders).join(known, "shipment_id", "left")
    out = rows.agg(F.count(F.lit(1)).alias("shipments"), F.count_if("known").alias("resolved"))
    out = out.withColumn("pending", F.col("shipments") - F.col("resolved"))
    return out.withColumn("fraction", F.coalesce(F.try_divide(F.col("resolved").cast("double"), F.col("shipments").cast("double")), F.lit(1.0)))


def merge_shipments(known: DataFrame, found: DataFrame) -> DataFrame:
    """Upsert: found rows win, the last by ordinal among them; blank ids and types are refused."""
    new = found.where(blank_to_null("shipment_id").isNotNull() & blank_to_null("logistic_type").isNotNull())
    new = new.select("shipment_id", "logistic_type", clean_cost().alias("custo_frete"), F.lit(1).alias("age"), (F.col("ordinal") if "ordinal" in found.columns else F.lit(0).cast("long")).alias("ordinal"))
    old = known.select("shipment_id", "logistic_type", "custo_frete", F.lit(0).alias("age"), F.lit(0).cast("long").alias("ordinal"))
    last = F.max(F.struct("age", "ordinal", "logistic_type", "custo_frete")).alias("x")
    return old.unionByName(new).groupBy("shipment_id").agg(last).select("shipment_id", "x.logistic_type", "x.custo_frete")


def shipments_by_type(shipments: DataFrame) -> DataFrame:
    """logistic_type, shipments (count): the types of all shipments."""
    return shipments.groupBy("logistic_type").agg(F.count(F.lit(1)).alias("shipments")).orderBy("logistic_type")


def shipment_ids_by_type(shipments: DataFrame) -> DataFrame:
    """logistic_type, place (from 1), shipment_id: every type's shipments in order of id, sorted by both.

    A row for each shipment instead of a list for each type, so a type may hold most of them.
    """
    return numbered(shipments.select("logistic_type", "shipment_id"), [F.asc("shipment_id")], ["logistic_type"], "place")
