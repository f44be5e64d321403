"""From a typed query to a DataFrame over one snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import margin, ranking, sales, shipping
from tideline.operators.costs import Fees, Logistics
from tideline.plans.periods import Coverage, Period, Window, comparable, coverage

# What a query may ask for, and the warnings that only go with a margin.
INTENTS = ("sales_summary", "sales_comparison", "sales_ranking")
METRICS = ("revenue", "orders", "average_ticket", "units", "margin")
MARGIN_WARNINGS = ("antes_de_publicidade", "custo_parcial", "ranking_margem_cobertura_parcial", "frete_estimado")


@dataclass(frozen=True)
class Query:
    """intent and metric of INTENTS and METRICS; compare for comparisons, rank_by and limit for rankings."""

    intent: str
    metric: str
    period: Period
    compare: Period | None = None
    rank_by: str | None = None
    limit: int | None = None


@dataclass
class Snapshot:
    """What queries read: orders, shipments, cost rules, and how far the data reaches.

    lines and facts hold the same sales at the grain of lines and of orders, where they are
    stored so; else orders are unnested as needed.
    """

    orders: DataFrame
    shipments: DataFrame
    rules: list
    window: Window
    fees: Fees = Fees()
    logistics: Logistics = Logistics()
    lines: DataFrame | None = None
    facts: DataFrame | None = None

    @classmethod
    def of(cls, orders: DataFrame, shipments: DataFrame, rules, last_sync_at: str | None = None, last_result: str | None = None, lines: DataFrame | None = None, facts: DataFrame | None = None) -> Snapshot:
        """The only probe that runs at once: the first and last date, one row."""
        bounds = sales.date_bounds(orders).first()
        window = Window(bounds["oldest_by_instant"], bounds["newest_by_instant"], False, last_sync_at, last_result)
        return cls(orders, shipments, rules, window, lines=lines, facts=facts)


@dataclass
class Result:
    """rows is None where the period isn't covered: unknown, not zero."""

    rows: DataFrame | None
    coverage: Coverage
    compared: Coverage | None = None
    warnings: tuple[str, ...] = ()


def united(*lists: tuple[str, ...]) -> tuple[str, ...]:
    """Each warning once, in the order of its first mention."""
    return tuple(dict.fromkeys(w for x in lists for w in x))


def without_margin(warnings: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(w for w in warnings if w not in MARGIN_WARNINGS)


def noted(rows: DataFrame) -> DataFrame:
    """Adds warnings to a summary: a covered period without orders is a true zero, and says so."""
    return rows.withColumn("warnings", F.when(F.col("orders") == 0, "sem_dados_no_periodo").otherwise(""))


def run(query: Query, snapshot: Snapshot) -> Result:
    if query.period.start > query.period.end:
        return Result(None, Coverage("indisponivel", query.period, None), warnings=("periodo_invalido",))
    found = coverage(query.period, snapshot.window)
    if query.intent == "sales_comparison" and query.compare:
        return compare(query, snapshot, found)
    if found.covered is None:
        return Result(None, found, warnings=found.warnings)
    start, end = found.covered.start, found.covered.end
    if query.intent == "sales_ranking" or query.metric == "margin":
        sold = snapshot.orders if snapshot.lines is None else snapshot.lines
        lines = margin.priced_lines(sold, snapshot.shipments, snapshot.rules, start, end, snapshot.fees, snapshot.logistics)
        if query.intent == "sales_ranking":
            rows = ranking.ranking(lines, query.rank_by or "revenue", query.limit)
            if query.rank_by == "margin":
                return Result(rows, found, warnings=united(found.warnings, MARGIN_WARNINGS[:1]))
            return Result(rows.select("position", "sku", "label", "revenue", "units", "orders"), found, warnings=without_margin(found.warnings))
        return Result(margin.margin_total(lines), found, warnings=found.warnings)
    sold = snapshot.orders if snapshot.facts is None else snapshot.facts
    return Result(noted(sales.sales_summary(sold, start, end)), found, warnings=found.warnings)


def compare(query: Query, snapshot: Snapshot, found: Coverage) -> Result:
    """Both periods and their change; no change where a side is covered by less than COMPARABLE."""
    other = coverage(query.compare, snapshot.window)
    warnings = united(found.warnings, other.warnings)
    if found.covered is None or other.covered is None:
        return Result(None, found, other, warnings)
    bounds = [(c.covered.start, c.covered.end) for c in (found, other)]
    rows = sales.compare_periods(snapshot.orders if snapshot.facts is None else snapshot.facts, *bounds)
    if comparable(found, other):
        return Result(rows, found, other, warnings)
    gone = {c: F.lit(None).cast("double") for c in rows.columns if c.endswith("_change")}
    return Result(rows.withColumns(gone), found, other, united(warnings, ("comparacao_cobertura_desigual",)))


def with_freight_coverage(result: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The result with one more column: the share of shipments whose cost is known (one row, broadcast)."""
    one = shipping.freight_coverage(snapshot.orders, snapshot.shipments).select(F.col("fraction").alias("freight_coverage"))
    return result.crossJoin(F.broadcast(one))
