"""A remote source as a stream: windows of known orders, broken runs, and buckets."""

import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.test_sales import order, orders
from tideline.operators.orders import known_window, merge_orders
from tideline.sources.snapshots import SnapshotError
from tideline.streaming import ingest, paged_source
from tideline.streaming.buckets import BucketedOrders


def remote(folder, n, first=0, fail_at=None):
    """n orders, newest first, in a file; the fetch fails at fail_at while the file `down` is there."""
    path = f"{folder}/source.json"
    rows = [{"id": str(i), "status": "paid", "paid_amount": 1.0 + i % 3, "date_created": "2026-08-01T12:00:00.000-03:00", "order_items": []} for i in range(first + n - 1, first - 1, -1)]
    with open(path, "w") as f:
        json.dump(rows, f)

    def fetch(offset, limit):
        if fail_at is not None and offset >= fail_at and limit > 1 and os.path.exists(f"{folder}/down"):
            raise OSError("the source is down")
        with open(path) as f:
            held = json.load(f)
        with open(f"{folder}/calls-{os.getpid()}", "a") as f:
            f.write(f"{offset} {limit}\n")
        return {"orders": held[offset : offset + limit], "total": len(held)}

    return fetch


def pages_read(folder):
    calls = [tuple(map(int, line.split())) for name in os.listdir(folder) if name.startswith("calls") for line in open(f"{folder}/{name}")]
    return sorted(at for at, limit in calls if limit > 1)


@pytest.fixture
def down(monkeypatch):
    monkeypatch.setattr(paged_source, "RETRIES", 0)
    monkeypatch.setattr(paged_source.time, "sleep", lambda s: None)


def test_a_broken_run_goes_on_with_the_next_page(spark, tmp_path):
    fetch = remote(tmp_path, 430, fail_at=200)
    (tmp_path / "down").touch()
    table = BucketedOrders(spark, f"file://{tmp_path}/table", 8)
    with pytest.raises(StreamingQueryException):
        ingest.sync(spark, fetch, table, "first", full=True, pages_at_once=2)
    assert table.read().count() == 200
    (tmp_path / "down").unlink()
    done = ingest.sync(spark, fetch, table, "first", full=True, pages_at_once=2)
    assert sorted(int(r.id) for r in table.read().collect()) == list(range(430))
    assert [d["new"] for d in done] == [100, 100, 30] and pages_read(tmp_path) == list(range(0, 430, 50))
    # The source grew: the run goes on from its own offset, as one that isn't over.
    assert ingest.sync(spark, fetch, table, "first", full=True) == []


def test_an_incremental_run_ends_with_its_window(spark, tmp_path):
    table = BucketedOrders(spark, f"file://{tmp_path}/table", 8)
    ingest.sync(spark, remote(tmp_path, 700), table, "full", full=True)
    fetch = remote(tmp_path, 760)
    for name in os.listdir(tmp_path):
        if name.startswith("calls"):
            os.unlink(tmp_path / name)
    done = ingest.sync(spark, fetch, table, "next", pages_at_once=3)
    # 60 new orders, then known ones: the 250th is the 310th order, on the page that ends at 350.
    assert table.read().count() == 760 and sum(d["new"] for d in done) == 60 and sum(d["changed"] for d in done) == 0
    assert set(pages_read(tmp_path)) <= set(range(0, 450, 50)) and {r.last for r in ingest.reviewed(table, "next").where("reached").collect()} == {349}
    assert ingest.sync(spark, fetch, table, "again", pages_at_once=3)[-1]["new"] == 0


def test_too_many_orders_at_the_source(spark, tmp_path):
    table = BucketedOrders(spark, f"file://{tmp_path}/table", 4)
    with pytest.raises(StreamingQueryException, match="safety limit"):
        ingest.sync(spark, remote(tmp_path, 60), table, "r", full=True, most=50)
    assert table.read().count() == 0


def test_malformed_pages_are_tried_again():
    calls, waits = [], []

    def flaky(offset, limit):
        calls.append(offset)
        return {"orders": [], "total": 0} if len(calls) > 2 else {}

    assert paged_source.fetch_page(flaky, 0, 50, wait=waits.append) == {"orders": [], "total": 0} and waits == [0.2, 0.4]
    with pytest.raises(SnapshotError):
        paged_source.fetch_page(lambda o, n: {"orders": 3}, 0, 50, wait=waits.append)


def files(table):
    root = table.root.removeprefix("file://") + "/orders"
    return {d: sorted(f for f in os.listdir(f"{root}/{d}") if f.endswith(".parquet")) for d in os.listdir(root) if d.startswith("bucket=")}


def test_a_batch_rewrites_its_own_buckets(spark, tmp_path):
    table = BucketedOrders(spark, f"file://{tmp_path}/table", 16)
    first = orders(spark, *[order(str(i), paid=1.0) for i in range(400)])
    assert table.merge(first, "a") == {"new": 400, "changed": 0, "buckets": 16}
    before = files(table)
    batch = orders(spark, order("7", paid=2.0), order("7", paid=9.0), order("1000", paid=1.0), order("8", paid=1.0))
    done = table.merge(batch, "b")
    touched = {f"bucket={r.bucket}" for r in batch.select(table.bucket()).toDF("bucket").distinct().collect()}
    after = files(table)
    assert (done["new"], done["changed"], done["buckets"]) == (1, 1, len(touched))
    assert {d for d in after if after[d] != before.get(d)} == touched and len(touched) < 4
    want = {(r.id, r.paid_amount) for r in merge_orders(first, batch).collect()}
    assert {(r.id, r.paid_amount) for r in table.read().collect()} == want
    assert table.merge(batch, "b") == {"new": 0, "changed": 0, "buckets": 0} and files(table) == after


def test_a_staged_batch_is_put_in_place_after_a_failure(spark, tmp_path, monkeypatch):
    table = BucketedOrders(spark, f"file://{tmp_path}/table", 4)
    table.merge(orders(spark, *[order(str(i), paid=1.0) for i in range(50)]), "a")
    batch = orders(spark, order("3", paid=5.0), order("99", paid=1.0))
    with monkeypatch.context() as m:
        m.setattr(BucketedOrders, "_apply", lambda self, staged: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.merge(batch, "b")
    for name in os.listdir(tmp_path / "table/orders"):  # as if the overwrite had only deleted
        if name.startswith("bucket="):
            (tmp_path / "table/orders" / name).rename(tmp_path / f"gone-{name}")
            break
    gone = int(name.removeprefix("bucket="))
    done = table.merge(batch, "b")
    assert (done["new"], done["changed"]) == (1, 1)
    held = {r.id: r.paid_amount for r in table.read().collect()}
    touched = {r[0] for r in batch.select(table.bucket()).collect()}
    assert held["3"] == 5.0 and held["99"] == 1.0 and (gone not in touched or len(held) == 51)


@pytest.mark.parametrize(("known", "window", "want"), [(range(60, 1000), 250, 350), (range(0, 1000), 250, 250), (range(0, 1000), 251, 300), ([5, 900], 3, 1000), ([], 1, 1000), ([999], 1, 1000), ([0], 1, 50)])
def test_known_window(spark, known, window, want):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("o")).repartition(7)
    base = spark.createDataFrame([(str(i),) for i in known], "id string")
    found = known_window(rows, base, [F.asc("o")], window).collect()
    assert sorted(r.o for r in found) == list(range(want)) and all(r.position == r.o and r.known == (r.o in set(known)) for r in found)
