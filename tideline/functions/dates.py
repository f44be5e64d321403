"""Instants and civil days of the seller's zone."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col

ZONE = "America/Sao_Paulo"
WEEK_SECONDS = 7 * 86_400


def instant(text: str | Column) -> Column:
    """The instant of a text with offset; null where it can't be read."""
    return F.try_to_timestamp(col(text))


def civil_day(ts: str | Column) -> Column:
    """The day in the seller's zone, whatever the session's zone."""
    return F.convert_timezone(None, F.lit(ZONE), col(ts)).cast("date")


def with_civil_date(orders: DataFrame) -> DataFrame:
    """Adds civil_date from date_created unless a stored one is there."""
    return orders if "civil_date" in orders.columns else orders.withColumn("civil_date", civil_day(instant("date_created")))


def in_period(day: str | Column, start: date | None, end: date | None) -> Column:
    """Inclusive on both sides; a missing bound is open, a missing day is outside."""
    inside = col(day).isNotNull()
    if start is not None:
        inside = inside & (col(day) >= F.lit(start))
    if end is not None:
        inside = inside & (col(day) <= F.lit(end))
    return inside


def in_optional_period(day: str | Column, start: date | None, end: date | None) -> Column:
    """As in_period, but without any bound everything is inside, missing days too."""
    return F.lit(True) if start is None and end is None else in_period(day, start, end)


def zone_offset(micros: Column) -> Column:
    """Microseconds by which the seller's clock is ahead of UTC at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), ZONE)) - micros


def _at(day: Column, micros: int) -> Column:
    """The instant at which the seller's clock shows a time of the day.

    The offset is first taken where the clock's time would be in UTC, and then once more at the
    instant which that gives, so both sides of a change of the clock come out right. A time that
    the clock skips or shows twice is settled by the same two steps.
    """
    shown = F.unix_date(day).cast("long") * F.lit(86_400_000_000) + F.lit(micros)
    return F.timestamp_micros(shown - zone_offset(shown - zone_offset(shown)))


def day_start(day: str | Column) -> Column:
    """0:00:00.000 of a civil day in the seller's zone."""
    return _at(col(day), 0)


def day_end(day: str | Column) -> Column:
    """23:59:59.999 of a civil day in the seller's zone."""
    return _at(col(day), 86_399_999_000)


def weeks_between(a: Column, b: Column) -> Column:
    """Fractional weeks from a to b, never negative; 0 where one is missing."""
    return F.greatest(F.lit(0.0), F.coalesce((F.unix_timestamp(b) - F.unix_timestamp(a)) / F.lit(WEEK_SECONDS), F.lit(0.0)))


def valid_day(text: str | Column) -> Column:
    """YYYY-MM-DD that exists in the calendar."""
    return F.coalesce(col(text).rlike(r"^\d{4}-\d{2}-\d{2}$") & col(text).try_cast("date").isNotNull(), F.lit(False))


def is_iso_instant(text: str | Column) -> Column:
    """A strict ISO instant: day, T, time (seconds and up to three decimals may follow), Z or an offset; and one that exists."""
    form = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?(\.\d{1,3})?(Z|[+-]\d{2}:\d{2})$"
    whole = F.regexp_replace(col(text), r"^(.{13}:\d{2})(Z|[+-])", "$1:00$2")  # seconds are read only where they stand
    return F.coalesce(col(text).rlike(form) & instant(whole).isNotNull(), F.lit(False))


def monday_of(day: str | Column) -> Column:
    """The Monday of the day's week; a Sunday belongs to the week that began six days before."""
    return F.trunc(col(day), "week")


def month_bounds(day: str | Column) -> Column:
    """struct(first, last): of the day's calendar month."""
    return F.struct(F.trunc(col(day), "month").alias("first"), F.last_day(col(day)).alias("last"))


def month_before(day: str | Column) -> Column:
    """The first day of the calendar month before the day's."""
    return F.add_months(F.trunc(col(day), "month"), -1)


def weekday(day: str | Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(col(day)) - 1


def elapsed_before(day: str | Column, unit: str) -> Column:
    """struct(first, last): as much of the unit before (week or month) as has gone by of the day's own."""
    if unit == "week":
        first = F.date_sub(monday_of(day), 7)
        return F.struct(first.alias("first"), F.date_add(first, weekday(F.date_sub(col(day), 1))).alias("last"))
    first = month_before(day)
    return F.struct(first.alias("first"), F.least(F.date_add(first, F.dayofmonth(col(day)) - 1), F.last_day(first)).alias("last"))
