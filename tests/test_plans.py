"""Periods, queries, snapshots and ingest."""

from datetime import date, datetime, timezone

import pytest

from tests.test_sales import order, orders
from tideline.plans import periods
from tideline.plans.periods import Period, Window
from tideline.plans.service import Query, Snapshot, run, united, without_margin
from tideline.sources import snapshots, star_schema
from tideline.streaming import ingest

WINDOW = Window("2025-07-21T10:30:37-04:00", "2026-08-03T02:02:28-04:00")
TODAY = date(2026, 7, 23)


@pytest.mark.parametrize(
    ("start", "end", "kind"),
    [
        ("2026-07-20", "2026-07-25", "total"),
        ("2025-07-21", "2025-07-21", "parcial"),
        ("2026-08-03", "2026-08-03", "parcial"),
        ("2025-07-22", "2026-08-02", "total"),
        ("2025-01-01", "2025-01-31", "indisponivel"),
        ("2026-09-01", "2026-09-30", "indisponivel"),
    ],
)
def test_coverage(start, end, kind):
    assert periods.coverage(Period(date.fromisoformat(start), date.fromisoformat(end)), WINDOW).kind == kind


def test_coverage_is_clipped_and_follows_the_sync():
    found = periods.coverage(Period(date(2025, 6, 1), date(2025, 8, 1)), WINDOW)
    assert (found.covered, found.kind) == (Period(date(2025, 7, 21), date(2025, 8, 1)), "parcial")
    synced = Window(WINDOW.oldest, WINDOW.newest, False, "2026-08-05T13:29:00Z", "sem_novos")
    kinds = [periods.coverage(Period(d, d), synced).kind for d in (date(2026, 8, 5), date(2026, 8, 4), date(2026, 8, 6))]
    assert kinds == ["parcial", "total", "indisponivel"]
    failed = Window(WINDOW.oldest, WINDOW.newest, False, "2026-08-05T13:29:00Z", "erro")
    assert periods.coverage(Period(date(2026, 8, 5), date(2026, 8, 5)), failed).kind == "indisponivel"


def test_request_periods():
    assert periods.period_of_request({}, date(2026, 7, 24)) == Period(date(2026, 7, 17), date(2026, 7, 24))
    for bad in ({"dias": "0"}, {"dias": "731"}, {"dias": "x"}, {"dias": 7, "from": "2026-01-01"}, {"from": "2026-01-01"}, {"from": "2026-02-30", "to": "2026-03-01"}, {"from": "2026-03-02", "to": "2026-03-01"}, {"x": 1}):
        with pytest.raises(periods.PeriodError):
            periods.period_of_request(bad, TODAY)


def test_periods_by_name():
    assert periods.last_days(TODAY, 15) == Period(date(2026, 7, 9), TODAY)
    assert periods.month_of(2026, 3, TODAY) == Period(date(2026, 3, 1), date(2026, 3, 31)) and periods.month_of(2026, 7, TODAY).end == TODAY
    assert periods.month_of(2025, 12, TODAY).end == date(2025, 12, 31)
    for bad in (lambda: periods.last_days(TODAY, 400), lambda: periods.last_days(TODAY, 0), lambda: periods.month_of(2026, 8, TODAY)):
        with pytest.raises(periods.PeriodError):
            bad()
    week, month, year = (periods.so_far_and_before(TODAY, u) for u in ("week", "month", "year"))
    assert week == (Period(date(2026, 7, 20), TODAY), Period(date(2026, 7, 13), date(2026, 7, 16)))
    assert month[1] == Period(date(2026, 6, 1), date(2026, 6, 23)) and year[1] == Period(date(2025, 1, 1), date(2025, 7, 23))
    assert periods.so_far_and_before(date(2028, 2, 29), "year")[1].end == date(2027, 2, 28)
    assert periods.so_far_and_before(date(2026, 3, 31), "month")[1] == Period(date(2026, 2, 1), date(2026, 2, 28))


def test_queries_over_a_snapshot(spark):
    folder = "/root/testdata/sf0.001"
    nested = Snapshot.of(star_schema.orders(spark, folder), star_schema.shipments(spark, folder), star_schema.RULES)
    flat = Snapshot.of(star_schema.order_heads(spark, folder), star_schema.shipments(spark, folder), star_schema.RULES, lines=star_schema.order_lines(spark, folder), facts=star_schema.order_facts(spark, folder))
    year = Period(date(1997, 1, 1), date(1997, 12, 31))
    for query in (
        Query("sales_summary", "revenue", year),
        Query("sales_summary", "margin", year),
        Query("sales_comparison", "revenue", year, compare=Period(date(1996, 1, 1), date(1996, 12, 31))),
        Query("sales_ranking", "margin", year, rank_by="margin", limit=7),
        Query("sales_ranking", "units", year, rank_by="units"),
    ):
        one, other = (run(query, s) for s in (nested, flat))
        assert one.coverage.kind == "total" and one.rows.columns == other.rows.columns
        assert [tuple(r) for r in one.rows.collect()] == [tuple(r) for r in other.rows.collect()], query
        assert ("antes_de_publicidade" in one.warnings) == (query.rank_by == "margin")
    none = run(Query("sales_summary", "revenue", Period(date(1990, 2, 1), date(1990, 2, 1))), flat)
    assert none.rows is None and none.coverage.kind == "indisponivel"
    assert run(Query("sales_summary", "revenue", Period(date(1997, 2, 2), date(1997, 2, 1))), flat).warnings == ("periodo_invalido",)
    early = Period(date(1990, 1, 1), date(1996, 12, 31))
    assert run(Query("sales_comparison", "revenue", early, compare=early), flat).warnings.count("cobertura_parcial_inicio") == 1
    assert united(("a", "b"), ("b", "c")) == ("a", "b", "c") and without_margin(("custo_parcial", "x")) == ("x",)


def test_snapshots(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/snap")
    assert store.read() is None and store.page()["error"] == "not_ready"
    rows = orders(spark, *[order(f"{i:04d}", paid=float(i), when=f"2026-08-{1 + i % 28:02d}T12:00:00.000-03:00") for i in range(1203)])
    made = store.publish(rows.repartition(5))
    assert (made.version, made.rows) == (1, 1203) and store.read(check=True).count() == 1203
    seen, cursor = [], None
    while True:
        page = store.page(cursor, 500)
        seen += [r.id for r in page["rows"].collect()]
        cursor = page["next"]
        if cursor is None:
            break
    assert sorted(seen) == [f"{i:04d}" for i in range(1203)] and len(seen) == 1203
    old = store.page(None, 10)["next"]
    store.publish(rows.limit(3))
    assert "rows" in store.page(old, 10)
    store.publish(rows.limit(2))
    assert store.page(old, 10)["error"] == "snapshot_changed"
    assert store.page("!!")["error"] == "invalid_cursor"
    with pytest.raises(snapshots.SnapshotError):
        store.publish(rows, complete=False)
    with pytest.raises(snapshots.SnapshotError):
        store.read(1)
    with pytest.raises(snapshots.SnapshotError):  # a second writer of the same version
        store._write_text("manifest-00000003.json", "{}")
    assert snapshots.decode_cursor(snapshots.encode_cursor(3, 7, "orders")) == {"v": 3, "o": 7, "a": "orders"}
    assert [snapshots.normal_page_size(x) for x in (1, 500, 501, True, "9")] == [1, 500, 200, 200, 200]


def test_shipments_are_cleaned_and_damage_counts_as_none(spark, tmp_path):
    store = snapshots.ShipmentStore(spark, f"file://{tmp_path}/ships")
    rows = spark.createDataFrame([("9", "a", -1.0), ("10", "b", 2.0), (" ", "a", 1.0), ("11", None, 1.0), ("12", "", 1.0)], "shipment_id string, logistic_type string, custo_frete double")
    store.publish(rows)
    assert [tuple(r) for r in store.page()["rows"].drop("seq").collect()] == [("10", "b", 2.0), ("9", "a", None)]
    (tmp_path / "ships" / "manifest-00000001.json").write_text("{bad")
    assert store.read() is None and store.publish(rows).version == 2 and store.read().count() == 2
    with pytest.raises(snapshots.SnapshotError):
        strict = snapshots.SnapshotStore(spark, f"file://{tmp_path}/ships")
        (tmp_path / "ships" / "manifest-00000002.json").write_text("{bad")
        strict.read()


def test_shipment_rows_of_both_forms(spark):
    raw = spark.createDataFrame([("1", '{"logistic_type":"x","custo_frete":2.5}'), ("2", "drop_off"), ("3", '{"logistic_type":"y","custo_frete":-1}'), ("", "x"), ("4", "{bad"), ("5", None)], "shipment_id string, value string")
    assert {tuple(r) for r in snapshots.read_shipments(raw).collect()} == {("1", "x", 2.5), ("2", "drop_off", None), ("3", "y", None)}


def test_stream_of_pages_is_merged(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/snap")
    pages = f"{tmp_path}/pages"
    first = orders(spark, order("10", paid=1.0), order("11", paid=1.0))
    first.coalesce(1).write.json(pages)
    ingest.start(spark, pages, store, f"{tmp_path}/ck").awaitTermination()
    assert store.read().count() == 2
    orders(spark, order("10", "cancelled", paid=1.0), order("12", paid=1.0)).coalesce(1).write.mode("append").json(pages)
    ingest.start(spark, pages, store, f"{tmp_path}/ck").awaitTermination()
    assert {(r.id, r.status) for r in store.read().collect()} == {("10", "cancelled"), ("11", "paid"), ("12", "paid")}
    assert store.status() | {"updated_at": 0, "newest_date": 0, "oldest_date": 0} == {"version": 2, "rows": 3, "oldest_date": 0, "newest_date": 0, "updated_at": 0, "last_result": "ok", "last_sync_at": None}
    assert ingest.apply_batch(store, orders(spark, order("12", paid=1.0)), "2026-08-05T13:29:00Z")["result"] == "sem_novos"
    assert store.status()["last_result"] == "sem_novos" and store.status()["last_sync_at"] == "2026-08-05T13:29:00Z"


def test_civil_today():
    assert periods.civil_today(datetime(2026, 7, 24, 2, 0, tzinfo=timezone.utc)) == date(2026, 7, 23)
