"""Lookups through injected functions: catalogue, freshness, shipments."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tests.test_sales import order, orders, ships
from tideline.sources import snapshots
from tideline.streaming import lookups

NOW = datetime(2026, 8, 1, 12, tzinfo=timezone.utc)


def pages(spark, n=45):
    return spark.createDataFrame([(lookups.STATUSES[i % 3], f"I{i:03d}", i) for i in range(n)] + [("deleted", "X", 1)], "status string, id string, place long")


def detail(ids):
    return [{"id": i, "title": f"t {i}", "status": lookups.STATUSES[int(i[1:]) % 3], "price": 1.5} for i in ids]


def test_catalogue_is_published_only_when_complete(spark, tmp_path):
    ids = lookups.ids_by_status(pages(spark))
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/items", ("ordinal",))
    made = lookups.rebuild_catalogue(store, ids, detail, NOW.isoformat(), parallel=2)
    assert made["complete"] and made["version"] == 1 and made["counts"] == {"total": 45, "active": 15, "paused": 15, "closed": 15}
    assert [r.status for r in store.page(None, 500)["rows"].collect()] == ["active"] * 15 + ["paused"] * 15 + ["closed"] * 15

    def flaky(batch):
        if "I003" in batch:
            raise OSError("no answer")
        return detail(batch)

    for fetch, why in ((flaky, ("lote_falhou",)), (lambda b: detail(b)[1:], ("id_sem_detalhe",))):
        made = lookups.rebuild_catalogue(store, ids, fetch, parallel=2)
        assert (made["complete"], made["reasons"], made["version"]) == (False, why, None)
    assert lookups.build_catalogue(ids, detail, max_calls=2)["reasons"] == ("teto_de_chamadas",)
    assert store.manifests()["current"].version == 1
    empty = lookups.rebuild_catalogue(store, ids.limit(0), detail)
    assert empty["complete"] and store.read().count() == 0


def test_freshness_and_fallback(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/items", ("ordinal",))
    build = lambda fetch=detail: lambda: lookups.rebuild_catalogue(store, lookups.ids_by_status(pages(spark, 4)), fetch, NOW.isoformat(), parallel=1)
    none = lookups.catalogue_now(store, build(lambda b: []), NOW, 60, 600)
    assert none["source"] is None and none["rows"] is None
    assert lookups.catalogue_now(store, build(), NOW, 60, 600)["source"] == "rebuilt"
    later = lookups.catalogue_now(store, build(), NOW + timedelta(seconds=90), 60, 600)
    assert later["source"] == "snapshot" and later["freshness"] == {"age_seconds": 90.0, "stale": True, "rebuild": False}
    old = lookups.catalogue_now(store, build(lambda b: []), NOW + timedelta(seconds=700), 60, 600)
    assert old["source"] == "fallback_stale" and old["warnings"] == ("catalogo_desatualizado",) and old["rows"].count() == 4
    assert lookups.age_seconds("bad", NOW) == float("inf") and lookups.age_seconds((NOW + timedelta(hours=1)).isoformat(), NOW) == 0


def test_shipment_step(spark):
    df = orders(spark, *[order(str(i), ship=f"S{i}", when=f"2026-08-0{i}T00:00:00.000-03:00") for i in range(1, 7)])
    known = ships(spark, ("S1", "x", 2.0))

    def fetch(i):
        if i == "S2":
            raise OSError("no answer")
        return {"S3": None, "S4": {"logistic_type": " ", "senders": []}, "S5": {"logistic_type": "a", "senders": [{"cost": 2.5}, {"cost": None}, {"cost": 1.0}]}, "S6": {"logistic_type": "b"}}[i]

    merged, told = lookups.shipment_step(df, known, fetch, 4)
    assert told == {"fetched": 4, "resolved": 2, "failed": 2, "remaining": 3, "distinct": 6, "done": False, "coverage": 0.5}
    assert {tuple(r) for r in merged.collect()} == {("S1", "x", 2.0), ("S5", "a", 3.5), ("S6", "b", 0.0)}
    _, none = lookups.shipment_step(df.limit(0), known, fetch)
    assert none["done"] and none["coverage"] == 1.0 and none["fetched"] == 0
    assert spark.range(1).select(lookups.senders_cost(F.lit(None).cast("array<struct<cost:double>>")).alias("c")).first().c == 0.0
