"""A remote source of order pages as a Spark streaming source.

The caller injects fetch(offset, limit), which gives {orders, total}. The driver asks only how
many orders there are; pages are fetched in tasks, one partition for each. Offsets are the
stream's own: they are written to its checkpoint, so a run that ends between two pages goes on
with the next one, and a batch that ends halfway is read again as a whole.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tideline.operators.orders import PAGE_ROWS
from tideline.sources.schemas import ORDER
from tideline.sources.snapshots import SnapshotError

MAX_ORDERS = 50_000
#: Pages of a micro-batch; they are fetched at the same time.
PAGES_AT_ONCE = 20
RETRIES = 2

Fetch = Callable[[int, int], dict]


@dataclass
class Page(InputPartition):
    offset: int
    limit: int


def fetch_page(fetch: Fetch, offset: int, limit: int, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> dict:
    """One page {orders, total}; a malformed page counts as a failure. Waits grow by 0.2 seconds."""
    for k in range(retries + 1):
        try:
            page = fetch(offset, limit)
            if isinstance(page, dict) and isinstance(page.get("orders"), list) and isinstance(page.get("total"), int):
                return page
            error: Exception = SnapshotError("malformed page")
        except Exception as e:  # noqa: BLE001 - whatever the source raises is tried again
            error = e
        if k < retries:
            wait(0.2 * (k + 1))
    raise error


def reader_of(fetch: Fetch, start: int, pages_at_once: int, most: int) -> DataSourceStreamReader:
    class Reader(DataSourceStreamReader):
        def __init__(self) -> None:
            self.planned = start

        def initialOffset(self) -> dict:
            return {"next": 0}

        def latestOffset(self) -> dict:
            total = fetch_page(fetch, self.planned, 1)["total"]
            if total > most:
                raise SnapshotError(f"{total} orders are more than the safety limit of {most}")
            return {"next": max(self.planned, min(total, self.planned + pages_at_once * PAGE_ROWS))}

        def partitions(self, start: dict, end: dict) -> list[Page]:
            self.planned = max(self.planned, end["next"])
            return [Page(at, min(PAGE_ROWS, end["next"] - at)) for at in range(start["next"], end["next"], PAGE_ROWS)]

        def read(self, partition: Page) -> Iterator[tuple[int, str]]:
            orders = fetch_page(fetch, partition.offset, partition.limit)["orders"]
            for i, order in enumerate(orders):
                yield partition.offset + i, json.dumps(order)

    return Reader()


def source_of(fetch: Fetch, pages_at_once: int = PAGES_AT_ONCE, most: int = MAX_ORDERS) -> type[DataSource]:
    """A data source that reads from fetch: position and the order's JSON. Its class travels to the tasks by value."""

    class PagedOrders(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_orders"

        def schema(self) -> str:
            return "position long, document string"

        def streamReader(self, schema) -> DataSourceStreamReader:
            return reader_of(fetch, int(self.options.get("start", "0")), pages_at_once, most)

    return PagedOrders


def logged_offset(spark: SparkSession, checkpoint: str) -> int:
    """Where the stream of a checkpoint stands: the end of its last batch that was committed, else the start."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    last = max((int(x) for x in done if x.isdigit()), default=None)
    if last is None:
        return 0
    # A text file of the offset log: version, metadata, then one line for each source.
    lines = [r.value for r in spark.read.text(f"{checkpoint}/offsets/{last}").collect()]
    return json.loads(lines[2])["next"]


def order_stream(spark: SparkSession, fetch: Fetch, checkpoint: str, pages_at_once: int = PAGES_AT_ONCE, most: int = MAX_ORDERS) -> DataFrame:
    """Orders as they come, with position (at the source) and ordinal (the same, unless the order has one)."""
    from pyspark.sql import functions as F

    spark.dataSource.register(source_of(fetch, pages_at_once, most))
    raw = spark.readStream.format("paged_orders").option("start", str(logged_offset(spark, checkpoint))).load()
    held = raw.select("position", F.from_json("document", ORDER).alias("o")).select("position", "o.*")
    return held.withColumn("ordinal", F.coalesce("ordinal", "position"))
