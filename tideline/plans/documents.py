"""Answers as documents: one row that holds query, result, coverage and warnings, nested.

A document is put together in the plan: results of a row or of a few ranked rows become
structs and short arrays, warnings an array of which functions keep what applies. Field names
are those that readers of the documents know. Lists that grow with the data (titles without
a cost) stay tables: margin.without_cost_titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.columns import total
from tideline.functions.places import kept
from tideline.operators import margin, ranking, sales
from tideline.plans.periods import Coverage, Period, civil_today, comparable, coverage, parse_instant
from tideline.plans.service import MARGIN_WARNINGS, Query, Snapshot


def struct(**fields) -> Column:
    """Fields by name; what isn't a column is a literal."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def text(value: object) -> Column:
    return F.lit(None if value is None else str(value)).cast("string")


def period_of(p: Period) -> Column:
    return struct(fromYmd=text(p.start), toYmd=text(p.end))


def query_of(q: Query, **more) -> Column:
    return struct(intent=q.intent, metric=q.metric, period=period_of(q.period), **more)


def coverage_of(found: Coverage, snapshot: Snapshot) -> Column:
    oldest, newest = (parse_instant(x) for x in (snapshot.window.oldest, snapshot.window.newest))
    covered = found.covered
    return struct(
        available=covered is not None,
        type=found.kind,
        effectiveFromYmd=text(covered and covered.start),
        effectiveToYmd=text(covered and covered.end),
        dataFromYmd=text(oldest and civil_today(oldest)),
        dataToYmd=text(newest and civil_today(newest)),
    )


def warnings_of(known: tuple[str, ...], **when: Column) -> Column:
    """The known warnings, then those whose condition holds; each once."""
    own = [F.when(c, F.lit(name)) for name, c in when.items()]
    return F.array_distinct(F.array_compact(F.array(*[F.lit(w) for w in known], *own, F.lit(None).cast("string"))))


def metrics(suffix: str = "") -> Column:
    ticket = "average_ticket" if not suffix else f"ticket{suffix}"
    return struct(revenue=F.col(f"revenue{suffix}"), orders=F.col(f"orders{suffix}"), averageTicket=F.col(ticket), units=F.col(f"units{suffix}"))


def unknown(spark: SparkSession, q: Query, found: Coverage, snapshot: Snapshot) -> DataFrame:
    """No result where the period isn't covered: unknown, not zero."""
    return spark.range(1).select(query_of(q).alias("query"), F.lit(None).cast("string").alias("result"), coverage_of(found, snapshot).alias("coverage"), warnings_of(found.warnings).alias("warnings"))


def summary(q: Query, snapshot: Snapshot, found: Coverage) -> DataFrame:
    rows = sales.sales_summary(snapshot.orders if snapshot.facts is None else snapshot.facts, found.covered.start, found.covered.end)
    notes = warnings_of(found.warnings, sem_dados_no_periodo=F.col("orders") == 0)
    return rows.select(query_of(q).alias("query"), metrics().alias("result"), coverage_of(found, snapshot).alias("coverage"), notes.alias("warnings"))


def comparison(q: Query, snapshot: Snapshot, found: Coverage) -> DataFrame:
    """Both periods, and their changes unless one is covered by too little to be compared."""
    other = coverage(q.compare, snapshot.window)
    spark = snapshot.orders.sparkSession
    if found.covered is None or other.covered is None:
        return unknown(spark, q, found if found.covered is None else other, snapshot)
    bounds = [(c.covered.start, c.covered.end) for c in (found, other)]
    rows = sales.compare_periods(snapshot.orders if snapshot.facts is None else snapshot.facts, *bounds)
    names = {"revenue": "revenue", "orders": "orders", "units": "units"}
    change = struct(**{f"{k}Abs": F.col(f"{v}_now") - F.col(f"{v}_before") for k, v in names.items()}, **{f"{k}Pct": F.col(f"{v}_change") for k, v in names.items()})
    fair = comparable(found, other)
    compared = struct(
        result=metrics("_before"),
        coverage=coverage_of(other, snapshot),
        variation=F.when(F.lit(fair), change),
        comparable=fair,
        coverageFraction=struct(current=found.fraction, previous=other.fraction),
    )
    empty = (F.col("orders_now") == 0) | (F.col("orders_before") == 0)
    notes = warnings_of((*found.warnings, *other.warnings, *(() if fair else ("comparacao_cobertura_desigual",))), sem_dados_no_periodo=empty)
    return rows.select(query_of(q, comparePeriod=period_of(q.compare)).alias("query"), metrics("_now").alias("result"), coverage_of(found, snapshot).alias("coverage"), compared.alias("compare"), notes.alias("warnings"))


def priced(snapshot: Snapshot, found: Coverage) -> DataFrame:
    sold = snapshot.orders if snapshot.lines is None else snapshot.lines
    return margin.priced_lines(sold, snapshot.shipments, snapshot.rules, found.covered.start, found.covered.end, snapshot.fees, snapshot.logistics)


def margin_document(q: Query, snapshot: Snapshot, found: Coverage) -> DataFrame:
    rows = margin.margin_total(priced(snapshot, found))
    result = F.when(
        F.col("available"),
        struct(productRevenue=F.col("revenue"), mlFee=F.col("marketplace_fee"), shippingFee=F.col("shipping_fee"), cost=F.col("cost"), margin=F.col("margin"), marginPct=F.col("margin_pct"), units=F.col("units")),
    )
    notes = F.array_distinct(F.concat(warnings_of(found.warnings), F.split("warnings", ",")))
    return rows.select(
        query_of(q).alias("query"),
        result.alias("result"),
        coverage_of(found, snapshot).alias("coverage"),
        struct(productRevenue=F.col("revenue_without_cost"), units=F.col("units_without_cost"), revenueShare=F.col("without_cost")).alias("noCost"),
        struct(actual=F.col("freight_real"), estimatedByPercent=F.col("freight_estimated"), revenueShareActual=F.col("real_freight")).alias("shippingCost"),
        F.lit(True).alias("beforeAdvertising"),
        F.lit(True).alias("estimated"),
        notes.alias("warnings"),
    )


def ranking_document(q: Query, snapshot: Snapshot, found: Coverage) -> DataFrame:
    """The first rows as an array, the period's totals over all rows, and for a margin what it rests on."""
    by = q.rank_by if q.rank_by in ranking.CRITERIA else "revenue"
    by_margin, n = by == "margin", ranking.ranking_limit(q.limit)
    lines = priced(snapshot, found)
    rows = kept(ranking.ranking_rows(lines, freight=True))  # read for the first rows and for the totals
    own = dict(rank=F.col("position"), sku=F.col("sku"), label=F.col("label"), units=F.col("units"), productRevenue=F.col("revenue"), orders=F.col("orders"))
    if by_margin:
        own |= dict(costKnown=F.col("cost_coverage") == "total", cost=F.col("cost"), margin=F.col("margin"), marginPct=F.col("margin_pct"))
    first = ranking.first_rows(rows, by, n).select(struct(**own).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("items"))
    full = F.col("cost_coverage") == "total"
    sums = rows.agg(
        total("revenue").alias("revenue"), total("units").alias("units"), F.count(F.lit(1)).alias("skus"), F.count_if(~full).alias("partly"),
        total(F.when(~full, F.col("revenue") - F.col("costed_revenue"))).alias("uncosted"), total(F.when(~full, F.col("uncosted_units"))).alias("uncosted_units"), total(F.when(full, F.col("revenue"))).alias("covered"),
        total("freight_real").alias("freight_real"), total("freight_estimated").alias("freight_estimated"), total("real_revenue").alias("real_revenue"), total("costed_revenue").alias("all_revenue"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    held = first.crossJoin(F.broadcast(sums))  # one row each
    notes = warnings_of(
        (*found.warnings, "antes_de_publicidade"),
        sem_dados_no_periodo=F.col("skus") == 0,
        custo_parcial=F.col("partly") > 0,
        frete_estimado=F.col("all_revenue") > F.col("real_revenue"),
        ranking_margem_cobertura_parcial=(F.col("partly") > 0) & F.lit(by_margin),
    )
    blocks = [
        struct(skus=F.col("partly"), productRevenue=F.col("uncosted"), units=F.col("uncosted_units"), revenueShare=share(F.col("uncosted"), F.col("revenue"))).alias("noCost"),
        struct(revenueShareWithCost=share(F.col("covered"), F.col("revenue")), skusExcluded=F.col("partly")).alias("marginCoverage"),
        struct(actual=F.col("freight_real"), estimatedByPercent=F.col("freight_estimated"), revenueShareActual=F.coalesce(F.try_divide("real_revenue", "all_revenue"), F.lit(1.0))).alias("shippingCost"),
        F.lit(True).alias("beforeAdvertising"),
        F.lit(True).alias("estimated"),
    ]
    return held.select(
        query_of(q, rankBy=by, limit=n).alias("query"),
        struct(basis="product_revenue", items=F.col("items")).alias("result"),
        struct(productRevenue=F.col("revenue"), units=F.col("units"), distinctSkus=F.col("skus")).alias("periodTotalsAllProducts"),
        coverage_of(found, snapshot).alias("coverage"),
        *(blocks if by_margin else []),
        F.filter(notes, lambda w: F.lit(by_margin) | ~w.isin(*MARGIN_WARNINGS)).alias("warnings"),
    )


def document(q: Query, snapshot: Snapshot) -> DataFrame:
    """One row: the answer to a query with what a reader needs to judge it."""
    if q.period.start > q.period.end:
        return unknown(snapshot.orders.sparkSession, q, Coverage("indisponivel", q.period, None, ("periodo_invalido",)), snapshot)
    found = coverage(q.period, snapshot.window)
    if q.intent == "sales_comparison" and q.compare:
        return comparison(q, snapshot, found)
    if found.covered is None:
        return unknown(snapshot.orders.sparkSession, q, found, snapshot)
    if q.intent == "sales_ranking":
        return ranking_document(q, snapshot, found)
    return margin_document(q, snapshot, found) if q.metric == "margin" else summary(q, snapshot, found)
