"""Incremental ingest: streams of order pages merged into a table of orders.

start() merges files of pages into a versioned snapshot, sync() pages of a remote source into
a bucketed table. Each micro-batch is one merge. The stream's checkpoint remembers what was
read, and a batch that is run again after a failure merges to the same rows, so nothing is
lost or counted twice.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.lines import first_seen
from tideline.operators.orders import KNOWN_WINDOW, change_counts, known_window, merge_orders
from tideline.sources.schemas import ORDER
from tideline.sources.snapshots import SnapshotStore
from tideline.streaming.buckets import BucketedOrders
from tideline.streaming.paged_source import MAX_ORDERS, PAGES_AT_ONCE, Fetch, order_stream

REVIEWED = "batch int, known long, last long, reached boolean"


def apply_batch(store: SnapshotStore, batch: DataFrame, updated_at: str | None = None, full: bool = False) -> dict:
    """Merges refreshed orders into the current version. Without changes nothing is published (sem_novos).

    Of two merges of one version the second fails when its manifest is there already.
    """
    batch = first_seen(batch).persist()  # read for the counts and for the merge
    try:
        done = _apply(store, batch, updated_at, full)
        store.note(done["result"], updated_at)
        return done
    finally:
        batch.unpersist()


def _apply(store: SnapshotStore, batch: DataFrame, updated_at: str | None, full: bool) -> dict:
    base = None if full else store.read()
    if base is None:
        made = store.publish(batch, updated_at)
        return {"result": "ok", "version": made.version, "new": made.rows, "changed": 0}
    version = store.manifests()["current"].version
    n = change_counts(base, batch).first()
    if not n["new"] and not n["changed"]:
        return {"result": "sem_novos", "version": version, "new": 0, "changed": 0}
    made = store.publish(merge_orders(base.drop("seq"), batch), updated_at)
    return {"result": "ok", "version": made.version, "new": n["new"], "changed": n["changed"]}


def start(spark: SparkSession, pages: str, store: SnapshotStore, checkpoint: str, files_per_batch: int = 5):
    """A streaming query over a folder of JSON order pages that stops when all are merged."""
    stream = spark.readStream.schema(ORDER).option("maxFilesPerTrigger", files_per_batch).json(pages)
    return (
        stream.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def reviewed(table: BucketedOrders, run: str) -> DataFrame:
    """batch, known (orders reviewed that were known), last (position of the last order reviewed), reached: a row for each batch of a run."""
    folder = f"runs/{run}/reviewed"
    return table.spark.read.schema(REVIEWED).json(f"{table.root}/{folder}/*") if table.exists(folder) else table.spark.createDataFrame([], REVIEWED)


def of_window(table: BucketedOrders, run: str, batch: DataFrame, batch_id: int) -> DataFrame:
    """The batch up to the end of the run's window of known orders; what was reviewed is noted before anything is merged.

    A batch that is run again keeps its own note, since its orders are known by then.
    """
    notes = {r.batch: r for r in reviewed(table, run).collect()}  # a row for each batch of the run
    if any(r.reached for i, r in notes.items() if i < batch_id):
        return batch.limit(0)
    left = KNOWN_WINDOW - sum(r.known for i, r in notes.items() if i < batch_id)
    if batch_id not in notes:
        cut = known_window(batch.withColumnRenamed("position", "source_position"), table.read(), [F.asc("source_position")], left)
        note = cut.agg(F.count_if("known").alias("known"), F.max("source_position").alias("last")).first()
        row = (batch_id, note["known"], note["last"], note["known"] >= left)
        table.spark.createDataFrame([row], REVIEWED).coalesce(1).write.mode("overwrite").json(f"{table.root}/runs/{run}/reviewed/{batch_id}")
        last = note["last"]
    else:
        last = notes[batch_id].last
    return batch.where(F.col("position") <= F.lit(last))


def sync(spark: SparkSession, fetch: Fetch, table: BucketedOrders, run: str, full: bool = False, pages_at_once: int = PAGES_AT_ONCE, most: int = MAX_ORDERS) -> list[dict]:
    """Reads a remote source, newest orders first, into the table; what each batch did.

    An incremental run ends with the page on which KNOWN_WINDOW known orders have been
    reviewed, a full one with the source. A run that was broken off goes on where its
    checkpoint stands; a new run starts at the newest order again.
    """
    folder = f"{table.root}/runs/{run}"
    done: list[dict] = []
    ended = threading.Event()

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch if full else of_window(table, run, batch, batch_id)
        done.append({"batch": batch_id, **table.merge(rows, f"{run}-{batch_id}")})
        if not full and reviewed(table, run).where("reached").limit(1).count():
            ended.set()

    stream = order_stream(spark, fetch, f"{folder}/checkpoint", pages_at_once, most)
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").start()
    while not query.awaitTermination(0.2):
        now = query.status
        idle = now["message"].startswith("Waiting") and not now["isDataAvailable"]
        if (idle or ended.is_set()) and not now["isTriggerActive"]:
            query.stop()
    return done
