"""Documents, bounds of civil days, labels by first sight, and callers' own functions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.test_texts_and_stock import listing, listings
from tideline.functions import dates
from tideline.operators import catalog, margin, sales
from tideline.plans import documents
from tideline.plans.periods import Period
from tideline.plans.service import MARGIN_WARNINGS, Query, Snapshot
from tideline.sources import star_schema

YEAR = Period(date(1997, 1, 1), date(1997, 12, 31))


@pytest.fixture(scope="module")
def snapshot(spark):
    return Snapshot.of(star_schema.order_heads(spark, SMALL), star_schema.shipments(spark, SMALL), star_schema.RULES, lines=star_schema.order_lines(spark, SMALL), facts=star_schema.order_facts(spark, SMALL))


def test_margin_warnings_go_with_margins_alone(snapshot):
    by_margin = documents.document(Query("sales_ranking", "margin", YEAR, rank_by="margin", limit=4), snapshot).first()
    assert set(by_margin.warnings) <= set(MARGIN_WARNINGS) and by_margin.warnings[0] == "antes_de_publicidade" and len(by_margin.warnings) > 1
    assert [x["rank"] for x in by_margin.result["items"]] == [1, 2, 3, 4] and all(x.costKnown for x in by_margin.result["items"]) and by_margin.noCost.skus > 0
    by_units = documents.document(Query("sales_ranking", "units", YEAR, rank_by="units"), snapshot)
    assert "noCost" not in by_units.columns and by_units.first().warnings == [] and len(by_units.first().result["items"]) == 5


def test_documents_without_data(snapshot):
    none = documents.document(Query("sales_summary", "revenue", Period(date(1990, 2, 1), date(1990, 2, 1))), snapshot).first()
    assert none.result is None and not none.coverage.available and none.coverage.type == "indisponivel"
    bad = documents.document(Query("sales_summary", "revenue", Period(date(1997, 2, 2), date(1997, 2, 1))), snapshot).first()
    assert bad.warnings == ["periodo_invalido"]
    day = star_schema.order_facts(snapshot.orders.sparkSession, SMALL).where("status <> 'cancelled'").select("civil_date").distinct()
    sold = {r.civil_date for r in day.collect()}
    quiet = next(d for d in (date.fromordinal(date(1995, 1, 2).toordinal() + i) for i in range(900)) if d not in sold)
    empty = documents.document(Query("sales_summary", "orders", Period(quiet, quiet)), snapshot).first()
    assert empty.result.orders == 0 and empty.result.averageTicket is None and empty.warnings == ["sem_dados_no_periodo"]


def test_unequal_coverage_has_no_variation(snapshot):
    early = Period(date(1990, 1, 1), date(1995, 12, 31))
    found = documents.document(Query("sales_comparison", "revenue", YEAR, compare=early), snapshot).first()
    assert found.compare.variation is None and not found.compare.comparable and "comparacao_cobertura_desigual" in found.warnings


@pytest.mark.parametrize(
    ("day", "start", "hours"),
    # A midnight that is skipped is read by the offset behind it, a last hour that comes twice by its first time.
    [("2026-07-24", "2026-07-24 03:00:00", 24), ("1997-02-15", "1997-02-15 02:00:00", 24), ("1997-02-16", "1997-02-16 03:00:00", 24), ("1997-10-06", "1997-10-06 02:00:00", 24), ("2018-11-04", "2018-11-04 02:00:00", 24), ("2018-11-03", "2018-11-03 03:00:00", 24)],
)
def test_bounds_of_days_with_a_change_of_the_clock(spark, day, start, hours):
    row = spark.sql(f"SELECT DATE '{day}' AS d").select(dates.day_start("d").cast("string").alias("s"), ((F.unix_millis(dates.day_end("d")) - F.unix_millis(dates.day_start("d")) + 1) / 3_600_000).alias("h")).first()
    assert (row.s, row.h) == (start, float(hours))


def test_labels_are_those_seen_first(spark):
    row = lambda sku, title, ordinal, pos: (sku, title, f"o{ordinal}", ordinal, pos, 10.0, 1.0, 1.0, 1.0, True, 5.0, 5.0, 1.0)
    rows = [row("S", "bb", 2, 0), row("S", "zz", 1, 1), row("S", "aa", 3, 0), row("S", "long title", 0, 0), row("S", "", 0, 1), row("T", "y", None, 0), row("T", "x", 9, 0), row("é", "t", 1, 0), row("z", "t", 1, 0)]
    schema = "sku string, title string, order_id string, ordinal long, pos int, revenue double, quantity double, marketplace_fee double, shipping_fee double, real boolean, unit_cost double, cost double, margin double"
    for part in (rows, rows[::-1]):
        found = margin.margin_by_sku(spark.createDataFrame(part, schema).repartition(3)).collect()
        assert {r.sku: r.label for r in found} == {"S": "zz", "T": "x", "é": "t", "z": "t"}
        assert [r.sku for r in found if r.sku in "éz"] == ["é", "z"]  # by bytes z would come first


def test_callers_functions(spark):
    rows = listings(spark, listing("A", "S", "k", 4.0), listing("B", "S", "k", 9.0), listing("C", "T", None, 2.0))
    orders = spark.createDataFrame([], "status string, first_item struct<item:struct<id:string>,quantity:double>, paid_amount double, total_amount double")
    found = catalog.consolidated(rows, orders, stock_of=lambda: F.sum("available_quantity"))
    assert {r.sku: r.stock for r in found.collect()} == {"S": 13.0, "T": 2.0}
    cancelled = spark.createDataFrame([(("g", "c1", "text"), 1.0, 1, "a"), (("g", "c2", "text"), 1.0, 2, "b"), (("g", "c3", None), 1.0, 3, "c")], "cancel_detail struct<`group`:string,code:string,description:string>, total_amount double, ordinal long, id string")
    label = lambda code: F.when(code == "c1", "label").when(code == "c2", "")
    assert {r.code: r.description for r in sales.cancel_reasons(cancelled, label).collect()} == {"c1": "label", "c2": "text", "c3": "Sem descricao"}


def test_calendar_columns_are_those_of_the_periods(spark):
    from datetime import timedelta

    from tideline.plans.periods import so_far_and_before

    days = [date(2023, 12, 20) + timedelta(days=i) for i in range(460)]
    week, month = dates.elapsed_before("d", "week"), dates.elapsed_before("d", "month")
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", dates.monday_of("d").alias("m"), dates.month_bounds("d").alias("b"), dates.month_before("d").alias("p"), dates.weekday("d").alias("w"), week.alias("week"), month.alias("month")).collect()
    for r in rows:
        for unit, found in (("week", r.week), ("month", r.month)):
            now, before = so_far_and_before(r.d, unit)
            assert (found["first"], found["last"]) == (before.start, before.end) and now.start == (r.m if unit == "week" else r.b["first"])
        assert r.w == r.d.isoweekday() % 7 and (r.b["last"] + timedelta(days=1)).day == 1 and r.p == (r.b["first"] - timedelta(days=1)).replace(day=1)


def test_strict_instants(spark):
    from tideline.plans.periods import parse_instant

    good = ["2026-08-05T13:29:00Z", "2026-08-05T13:29-03:00", "2026-08-05T13:29:00.1+05:30"]
    bad = ["2026-08-05", "2026-08-05T13:29:00", "2026-13-05T13:29:00Z", "2026-08-05 13:29:00Z", "20260805T132900Z", "", "2026-08-05T13:29:00.1234Z", None, "2026-08-05T25:00:00Z"]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", dates.is_iso_instant("t").alias("ok")).collect()
    assert {r.t for r in rows if r.ok} == set(good)
    assert all(parse_instant(t) for t in good) and not any(parse_instant(t) for t in bad)
