"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The statuses that count as a sale, and the logistics type of fulfilment.
SALE_STATUSES = ("paid", "partially_refunded")
FULFILMENT = "fulfillment"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_sale(status: str | Column = "status") -> Column:
    """An allow-list: unknown and missing statuses are no sales."""
    return F.coalesce(col(status).isin(*SALE_STATUSES), F.lit(False))


def is_fulfilment(logistic_type: str | Column = "logistic_type") -> Column:
    return F.coalesce(F.lower(col(logistic_type)) == FULFILMENT, F.lit(False))


def or_else(value: str | Column, fallback: Column) -> Column:
    """The fallback where the value is missing or 0; plain coalesce keeps the 0."""
    return F.coalesce(F.nullif(col(value), F.lit(0.0)), fallback)


def blank_to_null(text: str | Column) -> Column:
    return F.nullif(F.trim(col(text)), F.lit(""))


def exact(value: str | Column) -> Column:
    """The value as a decimal, in which sums don't depend on the order of rows; NaN and infinities count as missing."""
    return col(value).cast("decimal(28,8)")


def total(value: str | Column) -> Column:
    """An exact sum, 0 over no rows; missing values, and NaN, count as nothing."""
    return F.coalesce(F.sum(exact(value)), F.lit(0)).cast("double")


def fixed2(x: Column) -> Column:
    """Two decimal places of a non-negative number, exact ties up, judged by its binary value."""
    shown = F.regexp_replace(F.format_number(x, 2), ",", "").cast("double")
    return F.when(x * 8 == F.floor(x * 8), F.round(x, 2)).otherwise(shown)


def rounded(x: Column) -> Column:
    """The nearest whole number, ties up; for non-negative numbers."""
    return F.floor(x + 0.5)


def percent_change(now: Column, before: Column) -> Column:
    """Missing where there is nothing to compare with."""
    return F.try_divide(now - before, before) * 100


def shipment_id(raw: str | Column) -> Column:
    return blank_to_null(col(raw).cast("string"))


def line_sku(seller_sku: str | Column, item_id: str | Column) -> Column:
    """The group of an order line: its SKU, else a name made of the item."""
    return F.coalesce(blank_to_null(seller_sku), F.concat(F.lit("sem-sku-"), F.coalesce(col(item_id), F.lit("desconhecido"))))


def item_sku(custom: str | Column, attributes: str | Column, seller_sku: str | Column) -> Column:
    """A listing's SKU: custom field, else the first SELLER_SKU attribute, else seller_sku."""
    own = F.get(F.filter(attributes, lambda a: a["id"] == "SELLER_SKU"), 0)["value_name"]
    return F.coalesce(blank_to_null(custom), blank_to_null(own), blank_to_null(seller_sku))
