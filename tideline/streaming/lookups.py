"""Facts that a remote source gives by id: listings in batches, shipments one by one.

The caller's function is injected and runs in tasks (mapInPandas), a bounded number at once.
What it returns is written before it is used, so nothing is asked for twice in one run, and a
failure never ends the run: what failed is counted, and stays to be asked for again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.catalog import catalog_counts, slim_listings
from tideline.operators.shipping import batch_size, merge_shipments, pending_shipments, sale_shipments
from tideline.sources.schemas import LISTING
from tideline.sources.snapshots import Manifest, SnapshotStore, shared_folder

#: The statuses whose listings make the catalogue, in its order.
STATUSES = ("active", "paused", "closed")
BATCH_IDS = 20
MAX_CALLS = 200
PARALLEL, MAX_PARALLEL = 8, 32


def ids_by_status(pages: DataFrame) -> DataFrame:
    """id, ordinal of the listings of three statuses, one status after the other; repeated ids stay. pages: status, id, place."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return pages.where(rank > 0).select("id", (rank * F.lit(1 << 40) + F.col("place")).alias("ordinal"))


def asked(ids: DataFrame, fetch: Callable[[list[str]], list[dict]], batch: int, parallel: int) -> DataFrame:
    """answers (JSON of each found thing) and failed of each batch of ids, by ordinal."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                own = part.iloc[i : i + batch]
                try:
                    found, failed = [json.dumps(x) for x in fetch(own["id"].tolist())], False
                except Exception:  # noqa: BLE001 - whatever the source raises fails this batch alone
                    found, failed = [], True
                yield pd.DataFrame({"asked": [own["id"].tolist()], "ordinal": [int(own["ordinal"].iloc[0])], "answers": [found], "failed": [failed]})

    spread = ids.repartitionByRange(max(1, min(parallel, MAX_PARALLEL)), "ordinal").sortWithinPartitions("ordinal")
    answers = spread.mapInPandas(run, "asked array<string>, ordinal long, answers array<string>, failed boolean")
    path = f"{shared_folder(ids.sparkSession)}/lookups-{uuid.uuid4().hex}"
    answers.write.parquet(path)
    return ids.sparkSession.read.schema(answers.schema).parquet(path)


def build_catalogue(ids: DataFrame, fetch: Callable[[list[str]], list[dict]], max_calls: int = MAX_CALLS, parallel: int = PARALLEL) -> dict:
    """complete, reasons, calls, counts and rows (slim listings in the order of ids).

    Complete only if no batch failed and each id has become a listing; more batches than
    max_calls aren't begun.
    """
    n = ids.count()
    if -(-n // BATCH_IDS) > max_calls:
        return {"complete": False, "reasons": ("teto_de_chamadas",), "calls": 0, "counts": None, "rows": None}
    answers = asked(ids, fetch, BATCH_IDS, parallel)
    raw = answers.select("ordinal", F.posexplode("answers").alias("place", "text")).select(F.from_json("text", LISTING).alias("x"), F.col("ordinal").alias("first"), "place")
    raw = raw.select("x.*", "first", "place").withColumn("ordinal", F.col("first") + F.col("place"))
    rows = slim_listings(raw)
    told = answers.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.count_if("failed"), F.lit(0)).alias("failed")).first()
    counts = catalog_counts(rows).first().asDict()
    reasons = tuple(r for r, on in (("lote_falhou", told["failed"] > 0), ("id_sem_detalhe", told["failed"] == 0 and counts["total"] != n)) if on)
    return {"complete": not reasons, "reasons": reasons, "calls": told["calls"], "counts": counts, "rows": rows}


def rebuild_catalogue(store: SnapshotStore, ids: DataFrame, fetch: Callable[[list[str]], list[dict]], updated_at: str | None = None, max_calls: int = MAX_CALLS, parallel: int = PARALLEL) -> dict:
    """Builds the catalogue and publishes it if it is complete; else the published version stays. Adds version (None: not published)."""
    made = build_catalogue(ids, fetch, max_calls, parallel)
    version = store.publish(made["rows"], updated_at).version if made["complete"] else None
    return made | {"version": version}


def age_seconds(updated_at: str | None, now: datetime) -> float:
    """Whole seconds, never negative; infinite where the instant can't be read."""
    try:
        then = datetime.fromisoformat(updated_at or "")
        return float(max(0, int((now - then).total_seconds() // 1)))
    except (ValueError, TypeError):
        return float("inf")


def freshness(manifest: Manifest | None, now: datetime, soft: int, hard: int) -> dict:
    """age_seconds, stale (older than soft: still served) and rebuild (none, or older than hard)."""
    age = age_seconds(manifest.updated_at, now) if manifest else float("inf")
    return {"age_seconds": age, "stale": age > soft, "rebuild": manifest is None or age > hard}


def catalogue_now(store: SnapshotStore, rebuild: Callable[[], dict], now: datetime, soft: int, hard: int) -> dict:
    """rows, source (snapshot, rebuilt, fallback_stale; None without any), freshness, warnings.

    A version past hard is rebuilt; where that fails or is incomplete, the old one is served and says so.
    """
    held = store.manifests()["current"]
    told, warnings, source = freshness(held, now, soft, hard), [], "snapshot"
    if told["rebuild"]:
        try:
            source = "rebuilt" if rebuild()["version"] is not None else "fallback_stale"
        except Exception:  # noqa: BLE001 - whatever a rebuild raises leaves the old version
            source = "fallback_stale"
        if source == "fallback_stale":
            warnings.append("catalogo_desatualizado")
        held = store.manifests()["current"]
        told = freshness(held, now, soft, hard)
    return {"rows": store.read(), "source": source if held else None, "freshness": told, "warnings": tuple(warnings)}


def senders_cost(senders: str | Column) -> Column:
    """The sum of the finite costs of a shipment's senders; 0 without senders."""
    finite = lambda s: s["cost"].isNotNull() & ~F.isnan(s["cost"]) & (F.abs(s["cost"]) != float("inf"))
    return F.aggregate(F.filter(F.coalesce(senders, F.array().cast("array<struct<cost:double>>")), finite), F.lit(0.0), lambda acc, s: acc + s["cost"])


def shipment_step(orders: DataFrame, shipments: DataFrame, fetch: Callable[[str], dict | None], limit: float | None = None, parallel: int = PARALLEL) -> tuple[DataFrame, dict]:
    """The shipments with one batch of pending ones looked up, and counts of the step.

    fetch gives {logistic_type, senders: [{cost}]} of one shipment, or None. A shipment is resolved
    with a type and a finite cost; all others stay pending.
    """
    n = batch_size(float("nan") if limit is None else limit)
    batch = pending_shipments(orders, shipments, n).withColumn("ordinal", F.monotonically_increasing_id()).select(F.col("shipment_id").alias("id"), "ordinal")
    answers = asked(batch, lambda ids: [x for x in (fetch(i) for i in ids) if x is not None], 1, parallel)
    info = F.from_json(F.get("answers", F.lit(0)), "logistic_type string, senders array<struct<cost double>>")
    found = answers.select(F.get("asked", F.lit(0)).alias("shipment_id"), "ordinal", info.alias("x"), "failed")
    found = found.select("shipment_id", "ordinal", "x.logistic_type", F.when(~F.col("failed") & F.col("x").isNotNull(), senders_cost("x.senders")).alias("custo_frete"))
    good = found.where((F.trim("logistic_type") != "") & (F.col("custo_frete") >= 0))
    merged = merge_shipments(shipments, good)
    told = found.count(), good.count(), sale_shipments(orders).count(), pending_shipments(orders, merged, None).count()
    fetched, resolved, distinct, left = told
    counts = {"fetched": fetched, "resolved": resolved, "failed": fetched - resolved, "remaining": left, "distinct": distinct, "done": left == 0}
    return merged, counts | {"coverage": (distinct - left) / distinct if distinct else 1.0}
