"""Versioned tables: each version a folder of Parquet and a small manifest of its own.

A version is written once and whole, in order, then its manifest appears by one exclusive
rename: readers see the old version or the new one, and of two writers of one version the
second fails. The newest manifest is current and names the previous one; older versions are
deleted. Rows have a global ordinal, seq: their place in their range partition plus the rows
of the partitions before it (which the manifest holds), so pages read only what they need.
"""

from __future__ import annotations

import base64
import json
import re
import tempfile
import uuid
from dataclasses import asdict, dataclass
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.columns import blank_to_null
from tideline.operators.shipping import clean_cost

PAGE_SIZE, MAX_PAGE_SIZE = 200, 500
CURSOR_CHARS = 512


@dataclass(frozen=True)
class Manifest:
    version: int
    rows: int
    #: The rows of each range partition, in order.
    sizes: tuple[int, ...] = ()
    path: str = ""
    oldest_date: str | None = None
    newest_date: str | None = None
    updated_at: str | None = None
    complete: bool = True


class SnapshotError(RuntimeError):
    pass


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only in local mode without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tideline-")


class SnapshotStore:
    """tolerant: a damaged manifest counts as none; else it is an error."""

    def __init__(self, spark: SparkSession, root: str, order_by: tuple[str, ...] = ("date_created", "id"), tolerant: bool = False):
        self.spark, self.root, self.order_by, self.tolerant = spark, root.rstrip("/"), order_by, tolerant
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = self._hadoop.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read_text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode(errors="replace")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        """Written beside, then renamed unless the name is taken."""
        beside, target = self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self._fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        qualified = [self._fs.makeQualified(p) for p in (beside, target)]
        context = self._hadoop.FileContext.getFileContext(qualified[0].toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(*qualified, self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self._fs.delete(beside, False)
            raise SnapshotError(f"{name} is there already: the base changed during the publication") from e

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(m[1]) for m in map(re.compile(r"manifest-(\d{8})\.json").fullmatch, names) if m)

    def manifests(self) -> dict[str, Manifest | None]:
        """current and previous; none before the first version."""
        held = self._versions()
        if not held:
            return {"current": None, "previous": None}
        try:
            found = json.loads(self._read_text(self._path(f"{self.root}/manifest-{held[-1]:08d}.json")))
            made = {k: Manifest(**found[k] | {"sizes": tuple(found[k]["sizes"])}) if found.get(k) else None for k in ("current", "previous")}
        except (ValueError, TypeError, KeyError, AttributeError, Py4JJavaError) as e:
            if self.tolerant:
                return {"current": None, "previous": None}
            raise SnapshotError("the manifest can't be read") from e
        if made["current"] is None or not made["current"].complete:
            raise SnapshotError("the manifest names no complete version")
        return made

    def folder(self, version: int) -> str:
        return f"{self.root}/v{version:08d}"

    def publish(self, rows: DataFrame, updated_at: str | None = None, complete: bool = True) -> Manifest:
        """Writes a new version and makes it current; incomplete ones are refused."""
        if not complete:
            raise SnapshotError("an incomplete snapshot isn't published")
        before, held = self.manifests(), self._versions()
        version = held[-1] + 1 if held else 1
        path = f"{self.folder(version)}/{uuid.uuid4().hex}"
        ordered = rows.drop("seq").orderBy(*self.order_by)
        # Both numbers are of the range partitions in which rows are written.
        ordered.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
        written = self.spark.read.parquet(path)
        has_dates = "date_created" in rows.columns
        dates = [f(F.when(F.col("date_created") != "", F.col("date_created"))) for f in (F.min, F.max)] if has_dates else [F.lit(None).cast("string")] * 2
        # As many rows as there are partitions, not records.
        parts = written.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), dates[0].alias("low"), dates[1].alias("high")).collect()
        sizes = [0] * (max((r["__part"] for r in parts), default=-1) + 1)
        for r in parts:
            sizes[r["__part"]] = r["n"]
        low, high = min((r["low"] for r in parts if r["low"]), default=None), max((r["high"] for r in parts if r["high"]), default=None)
        made = Manifest(version, sum(sizes), tuple(sizes), path, low, high, updated_at, True)
        kept = before["current"]
        self._write_text(f"manifest-{version:08d}.json", json.dumps({"current": asdict(made), "previous": asdict(kept) if kept else None}))
        for old in held:
            if kept is None or old < kept.version:
                self._fs.delete(self._path(f"{self.root}/manifest-{old:08d}.json"), False)
                self._fs.delete(self._path(self.folder(old)), True)
        return made

    def note(self, result: str, at: str | None) -> None:
        """Keeps how the last ingest ended, and when."""
        out = self._fs.create(self._path(f"{self.root}/status.json"), True)
        out.write(bytearray(json.dumps({"last_result": result, "last_sync_at": at}).encode()))
        out.close()

    def status(self) -> dict:
        """version, rows, oldest_date, newest_date, updated_at of the current version, last_result and last_sync_at of the last ingest; None where unknown."""
        now, path = self.manifests()["current"], self._path(f"{self.root}/status.json")
        said = json.loads(self._read_text(path)) if self._fs.exists(path) else {"last_result": None, "last_sync_at": None}
        facts = {c: getattr(now, c) if now else None for c in ("version", "rows", "oldest_date", "newest_date", "updated_at")}
        return facts | {"rows": facts["rows"] or 0} | said

    def read(self, version: int | None = None, check: bool = False) -> DataFrame | None:
        """A version's rows with seq, the current one by default; None before the first. check compares its count with the manifest."""
        held = self.manifests()
        found = held["current"] if version is None else next((m for m in held.values() if m and m.version == version), None)
        if found is None:
            if version is None:
                return None
            raise SnapshotError(f"version {version} is gone")
        rows = self._rows(found)
        if check and rows.count() != found.rows:
            raise SnapshotError(f"version {found.version} has not the {found.rows} rows of its manifest")
        return rows.drop("__part", "__at")

    def _rows(self, found: Manifest) -> DataFrame:
        if not self._fs.exists(self._path(found.path)):
            raise SnapshotError(f"version {found.version} has no files")
        before = F.get(F.lit(list(accumulate(found.sizes, initial=0))), F.col("__part"))
        return self.spark.read.parquet(found.path).withColumn("seq", F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33) + before)

    def page(self, cursor: str | None = None, page_size: object = PAGE_SIZE, target: str = "orders") -> dict:
        """rows (DataFrame), next cursor, total. A cursor names its version; one that is gone says snapshot_changed."""
        size = normal_page_size(page_size)
        held = self.manifests()
        at = decode_cursor(cursor) if cursor else None
        if cursor and (at is None or at["a"] != target):
            return {"error": "invalid_cursor"}
        now = held["current"]
        if now is None:
            return {"error": "not_ready"}
        found = next((m for m in held.values() if m and (at is None or m.version == at["v"])), None)
        if found is None:
            return {"error": "snapshot_changed"}
        start = at["o"] if at else 0
        end = start + size
        # The page's rows are runs of written numbers, which Parquet's statistics find.
        runs = F.lit(False)
        for part, (n, before) in enumerate(zip(found.sizes, accumulate(found.sizes, initial=0))):
            if before < end and start < before + n:
                runs |= F.col("__at").between((part << 33) + max(0, start - before), (part << 33) + min(n, end - before) - 1)
        rows = self._rows(found).where(runs).drop("__part", "__at").orderBy("seq")
        return {"rows": rows, "total": found.rows, "version": found.version, "next": encode_cursor(found.version, end, target) if end < found.rows else None}


class ShipmentStore(SnapshotStore):
    """Shipments by id. Rows without id or type aren't published, and a damaged manifest counts as none: shipments are looked up again."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, ("shipment_id",), tolerant=True)

    def publish(self, rows: DataFrame, updated_at: str | None = None, complete: bool = True) -> Manifest:
        named = blank_to_null("shipment_id").isNotNull() & blank_to_null("logistic_type").isNotNull()
        return super().publish(rows.where(named).select("shipment_id", "logistic_type", clean_cost().alias("custo_frete")), updated_at, complete)


def normal_page_size(n: object) -> int:
    return n if isinstance(n, int) and not isinstance(n, bool) and 1 <= n <= MAX_PAGE_SIZE else PAGE_SIZE


def encode_cursor(version: int, offset: int, target: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": version, "o": offset, "a": target}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(text: str) -> dict | None:
    """The cursor's fields, or None if anything about it is wrong."""
    if not text or len(text) > CURSOR_CHARS or not re.fullmatch(r"[A-Za-z0-9_-]+", text):
        return None
    try:
        d = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError:
        return None
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    return d if isinstance(d, dict) and whole(d.get("v")) and d["v"] > 0 and whole(d.get("o")) and d["o"] >= 0 and isinstance(d.get("a"), str) else None


def read_shipments(raw: DataFrame) -> DataFrame:
    """Shipments from rows (shipment_id, value): value a JSON object, or a bare type of the older form.

    Rows that can't be read are skipped; a missing, negative or infinite cost is unknown.
    """
    parsed = F.from_json("value", "logistic_type string, custo_frete double")
    bare = F.when(~F.col("value").startswith("{"), F.trim(F.translate("value", '"', "")))
    rows = raw.select("shipment_id", F.coalesce(parsed["logistic_type"], bare).alias("logistic_type"), parsed["custo_frete"].alias("c"))
    cost = clean_cost("c").alias("custo_frete")
    return rows.where(F.coalesce((F.trim("shipment_id") != "") & (F.col("logistic_type") != ""), F.lit(False))).select("shipment_id", "logistic_type", cost)
