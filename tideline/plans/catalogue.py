"""All registered queries over the star-schema tables, and the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import dates, text
from tideline.operators import catalog, costs, dashboard, lines, margin, orders, ranking, sales, shipping, stock
from tideline.plans import documents, periods
from tideline.plans.oracles import BEFORE, NOW, SQL
from tideline.plans.service import Query, Snapshot, run
from tideline.sources import snapshots
from tideline.sources import star_schema as star

#: Columns that are ratios get four places, other fractions two.
RATIOS = ("fraction", "without_cost", "real_freight")
TODAY = date(1997, 12, 10)


def shown(df: DataFrame, *names: str) -> DataFrame:
    """The named columns (all by default), fractions rounded: money is exact to the cent, ratios to four places."""
    kinds = dict(df.dtypes)
    one = lambda c: F.round(c, 4 if c in RATIOS else 2).alias(c) if kinds[c] == "double" else F.col(c)
    return df.select(*[one(c) for c in names or df.columns])


def priced(s: SparkSession, d: str) -> DataFrame:
    return margin.priced_lines(star.order_lines(s, d, star.RULES), star.shipments(s, d), star.RULES, *NOW)


def units(s: SparkSession, d: str) -> DataFrame:
    return sales.units_by_item(star.order_lines(s, d), date(1997, 11, 10), TODAY)


def sku_weekly(s: SparkSession, d: str) -> DataFrame:
    found = sales.sales_by_sku(star.order_lines(s, d), star.sku_map(s, d), *NOW, week_of=F.weekofyear)
    weeks = found.select("sku", "units", "revenue", F.explode("by_week").alias("week", "week_units"))
    return shown(weeks)


def coverage_window(s: SparkSession, d: str) -> DataFrame:
    bounds = sales.date_bounds(star.order_heads(s, d))
    return bounds.select("oldest_date", "newest_date")


def snapshot(s: SparkSession, d: str) -> Snapshot:
    return Snapshot.of(star.order_heads(s, d), star.shipments(s, d), star.RULES, lines=star.order_lines(s, d, star.RULES), facts=star.order_facts(s, d))


def period_clip(s: SparkSession, d: str) -> DataFrame:
    """Sales of a period that reaches beyond the data, clipped to it on the driver."""
    held = snapshot(s, d)
    found = periods.coverage(periods.Period(date(1994, 1, 1), date(1995, 6, 30)), held.window)
    rows = sales.sales_summary(held.facts, found.covered.start, found.covered.end)
    return shown(rows.withColumns({"coverage": F.lit(found.kind), "covered_from": F.lit(found.covered.start), "covered_to": F.lit(found.covered.end)}))


def typed(intent: str, metric: str, period: periods.Period, *names: str, **more):
    """A query's rows over the snapshot."""

    def build(s: SparkSession, d: str) -> DataFrame:
        return shown(run(Query(intent, metric, period, **more), snapshot(s, d)).rows, *names)

    return build


def opened(df: DataFrame) -> DataFrame:
    """A document's fields as columns: names of nested ones joined by _, lists of words by commas."""
    while any(t.startswith("struct") for _, t in df.dtypes):
        df = df.select(*[c for n, t in df.dtypes for c in ([F.col(f"{n}.{f}").alias(f"{n}_{f}") for f in df.schema[n].dataType.names] if t.startswith("struct") else [F.col(n)])])
    df = df.select(*[F.array_join(n, ",").alias(n) if t == "array<string>" else F.col(n) for n, t in df.dtypes])
    return df.select(*[F.round(n, 4).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def answered(intent: str, metric: str, period: periods.Period, **more):
    """A query's document, its fields as columns; a ranking gives a row for each of its items."""

    def build(s: SparkSession, d: str) -> DataFrame:
        found = documents.document(Query(intent, metric, period, **more), snapshot(s, d))
        if intent == "sales_ranking":
            found = found.withColumn("item", F.explode("result.items")).drop("result")
        return opened(found)

    return build


def fixed_windows(s: SparkSession, d: str) -> DataFrame:
    return shown(sales.windows_summary(star.order_facts(s, d), dashboard.fixed_windows(TODAY, *NOW)))


def cost_rule_match(s: SparkSession, d: str) -> DataFrame:
    rows = star.order_lines(s, d).withColumn("rule", costs.rule_of("title", "seller_sku", star.RULES))
    rows = rows.select(F.coalesce("rule.rule_id", F.lit("none")).alias("rule_id"), F.coalesce("rule.via", F.lit("none")).alias("via"))
    return rows.groupBy("rule_id", "via").agg(F.count(F.lit(1)).alias("lines"))


def rule_table_match(s: SparkSession, d: str) -> DataFrame:
    """Each part's rule from a table of as many rules."""
    rows = costs.with_rule_table(star.parts(s, d), star.rule_table(s, d))
    return shown(rows, "item_id", "rule_id", "product_cost", "via")


def kit_multiplier(s: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.lit("Kit com "), (F.col("p_partkey") % 30).cast("string"), F.lit(" Garrafas "), "p_name")
    part = star.read(s, d, "part")
    return part.select("p_partkey", text.bottles(title).alias("bottles"), text.normal_title(F.concat("p_name", F.lit(" Kit com 6 Un"))).alias("normal"))


def unit_cost(s: SparkSession, d: str) -> DataFrame:
    rows = priced(s, d).where("unit_cost is not null")
    return shown(rows.groupBy("rule_id", "logistic_type").agg(F.min("unit_cost").alias("low"), F.max("unit_cost").alias("high"), F.count(F.lit(1)).alias("lines")))


def freight_share(s: SparkSession, d: str) -> DataFrame:
    rows = lines.sale_lines(star.order_lines(s, d), star.shipments(s, d)).where(dates.in_period("civil_date", *NOW))
    return shown(rows.groupBy("sku").agg(margin.total("freight_share").alias("freight"), F.count("freight_share").alias("lines_known"), F.count(F.lit(1)).alias("lines")))


def page_window(s: SparkSession, d: str) -> DataFrame:
    """The third page of a published snapshot, 200 rows by ordinal."""
    store = snapshots.SnapshotStore(s, f"{snapshots.shared_folder(s)}/page-window-{uuid.uuid4().hex}", ("ordinal",))
    made = store.publish(star.order_heads(s, d))
    page = store.page(snapshots.encode_cursor(made.version, 400, "orders"), 200)
    return shown(page["rows"], "id", "status", "ordinal", "total_amount")


def civil_day_shift(s: SparkSession, d: str) -> DataFrame:
    """Order times as UTC instants, by the civil day of the seller's zone."""
    ts = F.col("o_orderdate").cast("string")
    moment = F.to_timestamp(F.concat(ts, F.lit("Z"))) + F.make_dt_interval(hours=F.col("o_orderkey") % 24)
    o = star.read(s, d, "orders").select(dates.civil_day(moment).alias("civil_day"))
    return o.groupBy("civil_day").agg(F.count(F.lit(1)).alias("orders"))


def day_bounds(s: SparkSession, d: str) -> DataFrame:
    """Start and end of every civil day with orders, in milliseconds, and its length."""
    days = star.order_heads(s, d).select("civil_date").distinct()
    start, end = (F.unix_millis(x) for x in (dates.day_start("civil_date"), dates.day_end("civil_date")))
    return days.select("civil_date", start.alias("start_ms"), end.alias("end_ms"), ((end - start + 1) / 3_600_000).cast("int").alias("hours"))


def calendar_of_sales(s: SparkSession, d: str) -> DataFrame:
    """Sales by the Monday of their week, with the calendar that comparisons of that week use."""
    rows = sales.sales_in(star.order_heads(s, d), *NOW).select(dates.monday_of("civil_date").alias("monday"), "civil_date", sales.paid().alias("amount"))
    weeks = rows.groupBy("monday").agg(F.count(F.lit(1)).alias("orders"), margin.total("amount").alias("amount"), F.max("civil_date").alias("newest"))
    month, week, before = dates.month_bounds("newest"), dates.elapsed_before("newest", "week"), dates.elapsed_before("newest", "month")
    return shown(weeks.select("monday", "orders", "amount", "newest", dates.weekday("newest").alias("weekday"), month["first"].alias("month_first"), month["last"].alias("month_last"), dates.month_before("newest").alias("month_before"),
                              week["first"].alias("week_before_first"), week["last"].alias("week_before_last"), before["last"].alias("month_before_last")))


def consolidated_by_group(s: SparkSession, d: str) -> DataFrame:
    """The consolidated view with a caller's own stock of a group: what its active listings have."""
    own = lambda: F.coalesce(F.sum(F.when(F.col("status") == "active", F.greatest(F.col("available_quantity"), F.lit(0.0)))), F.lit(0.0))
    return shown(catalog.consolidated(star.listings(s, d), star.order_facts(s, d), stock_of=own), "sku", "label", "orders", "stock")


def cancel_labels(s: SparkSession, d: str) -> DataFrame:
    """Reasons for cancellation with a caller's labels for some of the codes."""
    heads = star.order_heads(s, d).where("status = 'cancelled'")
    coded = F.struct("cancel_detail.group", F.concat(F.lit("c"), (F.col("ordinal") % 4).cast("string")).alias("code"), "cancel_detail.description")
    label = lambda code: F.when(code.isin("c1", "c2"), F.concat(F.lit("motivo "), F.upper(code))).when(code == "c3", "")
    return shown(sales.cancel_reasons(heads.withColumn("cancel_detail", coded), label))


def slim_projection(s: SparkSession, d: str) -> DataFrame:
    rows = orders.slim_orders(star.orders(s, d))
    return shown(rows.select("id", "status", F.size("order_items").cast("long").alias("lines"), F.col("buyer.nickname").alias("nickname"), F.col("shipping.id").alias("shipment"), "paid_amount"))


def dedup_first_wins(s: SparkSession, d: str) -> DataFrame:
    o = star.order_heads(s, d).select("id", "ordinal", "total_amount")
    again = o.where("ordinal % 3 = 0").withColumns({"total_amount": F.col("total_amount") + 1, "ordinal": F.col("ordinal") + 1_000_000_000})
    return shown(lines.first_seen(o.unionByName(again)).select("id", "total_amount"))


def merge_refresh(s: SparkSession, d: str) -> DataFrame:
    merged = orders.merge_orders(star.order_heads(s, d).drop("cancel_detail"), star.refreshed(s, d))
    return shown(merged.groupBy("status").agg(F.count(F.lit(1)).alias("orders"), margin.total("total_amount").alias("amount")))


def merge_upsert(s: SparkSession, d: str) -> DataFrame:
    known = star.shipments(s, d)
    found = known.where("cast(shipment_id as long) % 14 = 0").withColumn("custo_frete", F.lit(9.5))
    merged = shipping.merge_shipments(known, found)
    return shown(merged.groupBy("logistic_type").agg(F.count(F.lit(1)).alias("shipments"), F.count("custo_frete").alias("known"), margin.total("custo_frete").alias("cost")))


def event_hours(s: SparkSession, d: str) -> DataFrame:
    """The ingest stream's events by hour and type."""
    e = star.read(s, d, "events")
    return shown(e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("events"), margin.total("value").alias("amount")))


def stock_view(view: str, mode: str):
    def build(s: SparkSession, d: str) -> DataFrame:
        return shown(stock.stock_by_sku(star.listings(s, d), None, view=view, mode=mode), "sku", "listings", "stock", "max_price")

    return build


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sales_summary": lambda s, d: shown(sales.sales_summary(star.order_facts(s, d), *NOW)),
    "sales_summary_empty_period": lambda s, d: shown(sales.sales_summary(star.order_facts(s, d), date(2031, 1, 1), date(2031, 1, 31))),
    "gross_net_period": lambda s, d: shown(sales.gross_and_net(star.order_heads(s, d), *NOW)),
    "sales_by_first_item": lambda s, d: shown(sales.sales_by_first_item(star.order_facts(s, d), *NOW)),
    "sku_detail": lambda s, d: shown(sales.sku_detail(star.order_lines(s, d), star.sku_map(s, d), "Brand#13", *NOW)),
    "sku_weekly": sku_weekly,
    "revenue_monthly_text": lambda s, d: shown(sales.revenue_by_text_month(star.order_heads(s, d))),
    "revenue_daily_month": lambda s, d: shown(sales.revenue_by_day(star.order_heads(s, d), 1997, 3)),
    "cancel_reasons": lambda s, d: shown(sales.cancel_reasons(star.order_heads(s, d).where("status = 'cancelled'"))),
    "units_by_item": lambda s, d: shown(sales.units_by_item(star.order_lines(s, d), *NOW)),
    "status_counts": lambda s, d: sales.status_counts(star.order_heads(s, d)),
    "dedup_first_wins": dedup_first_wins,
    "slim_projection": slim_projection,
    "coverage_window": coverage_window,
    "period_clip": period_clip,
    "compare_periods": lambda s, d: shown(sales.compare_periods(star.order_facts(s, d), NOW, BEFORE)),
    "fixed_windows": fixed_windows,
    "question_revenue": typed("sales_summary", "revenue", periods.month_of(1997, 3, TODAY), "revenue", "orders", "units", "average_ticket"),
    "question_rolling": typed("sales_summary", "units", periods.last_days(TODAY, 30)),
    "question_empty": typed("sales_summary", "orders", periods.Period(date(1995, 6, 18), date(1995, 6, 18))),
    "question_comparison": typed("sales_comparison", "revenue", periods.Period(*NOW), compare=periods.Period(*BEFORE)),
    "question_ranking": typed("sales_ranking", "units", periods.Period(*NOW), rank_by="units", limit=3),
    "question_margin": typed("sales_summary", "margin", periods.Period(*NOW), "revenue", "cost", "margin", "available", "warnings"),
    "document_summary": answered("sales_summary", "revenue", periods.month_of(1997, 3, TODAY)),
    "document_comparison": answered("sales_comparison", "revenue", periods.Period(*NOW), compare=periods.Period(*BEFORE)),
    "document_margin": answered("sales_summary", "margin", periods.Period(*NOW)),
    "document_ranking_margin": answered("sales_ranking", "margin", periods.Period(*NOW), rank_by="margin", limit=20),
    "document_ranking_units": answered("sales_ranking", "units", periods.Period(*NOW), rank_by="units", limit=3),
    "day_bounds": day_bounds,
    "calendar_of_sales": calendar_of_sales,
    "consolidated_by_group": consolidated_by_group,
    "cancel_labels": cancel_labels,
    "cost_rule_match": cost_rule_match,
    "rule_table_match": rule_table_match,
    "kit_multiplier": kit_multiplier,
    "unit_cost": unit_cost,
    "shipment_base": lambda s, d: shown(lines.shipment_base(star.order_lines(s, d))),
    "freight_share": freight_share,
    "freight_coverage": lambda s, d: shown(shipping.freight_coverage(star.order_heads(s, d), star.shipments(s, d))),
    "margin_total": lambda s, d: shown(margin.margin_total(priced(s, d)), *"revenue marketplace_fee shipping_fee cost units margin margin_pct revenue_without_cost without_cost real_freight available warnings".split()),
    "margin_by_sku": lambda s, d: shown(margin.margin_by_sku(priced(s, d)), *"sku label revenue marketplace_fee shipping_fee cost units freight_real freight_estimated margin margin_pct".split()),
    "margin_rollup": lambda s, d: shown(margin.margin_sets(priced(s, d)), *"is_total sku revenue cost margin revenue_without_cost".split()),
    "margin_best": lambda s, d: shown(margin.best_margins(margin.margin_by_sku(priced(s, d))), "sku", "margin"),
    "margin_worst": lambda s, d: shown(margin.worst_margins(margin.margin_by_sku(priced(s, d))), "sku", "margin"),
    "no_cost_report": lambda s, d: shown(margin.without_cost_titles(priced(s, d))),
    "ranking_revenue": lambda s, d: shown(ranking.ranking(priced(s, d), "revenue"), *"position sku label revenue units orders items cost_coverage".split()),
    "ranking_units": lambda s, d: shown(ranking.ranking(priced(s, d), "units", 10), *"position sku units orders".split()),
    "ranking_margin": lambda s, d: shown(ranking.ranking(priced(s, d), "margin", 20), *"position sku margin margin_pct".split()),
    "ranking_everything": lambda s, d: shown(ranking.ranking(priced(s, d), "revenue", everything=True), *"position sku revenue cost_coverage margin".split()),
    "margin_coverage": lambda s, d: shown(ranking.margin_coverage(ranking.ranking_rows(priced(s, d)))),
    "margin_route_totals": lambda s, d: shown(ranking.margin_totals(ranking.ranking_rows(priced(s, d)))),
    "catalog_counts": lambda s, d: catalog.catalog_counts(star.listings(s, d)),
    "slim_listings": lambda s, d: shown(catalog.slim_listings(star.listings(s, d)), "id", "title", "status", "price", "available_quantity", "inventory_id"),
    "consolidated": lambda s, d: shown(catalog.consolidated(star.listings(s, d), star.order_facts(s, d))),
    "stock_own_legacy": stock_view("own", stock.LEGACY),
    "stock_own_safe": stock_view("own", stock.SAFE),
    "stock_full_safe": stock_view("full", stock.SAFE),
    "stock_consolidated": lambda s, d: stock.consolidate(stock.stock_lines(star.listings(s, d))),
    "stock_audit_safe": lambda s, d: stock.audit(stock.stock_lines(star.listings(s, d))),
    "stock_audit_legacy": lambda s, d: stock.legacy_audit(stock.stock_lines(star.listings(s, d), stock.LEGACY)),
    "dashboard_parts": lambda s, d: shown(dashboard.dashboard_rows(star.orders(s, d), NOW, TODAY, *NOW)),
    "stock_alerts": lambda s, d: stock.alerts(stock.stock_lines(star.listings(s, d))),
    "stock_class": lambda s, d: shown(stock.stock_by_sku(star.listings(s, d), units(s, d)).withColumn("days_of_stock", F.col("days_of_stock").cast("double")), "sku", "stock", "sold", "velocity", "days_of_stock", "class"),
    "pending_shipments": lambda s, d: shipping.pending_shipments(star.order_heads(s, d), star.shipments(s, d), None),
    "pending_counts": lambda s, d: shipping.pending_counts(star.order_heads(s, d), star.shipments(s, d), 50),
    "pending_batch": lambda s, d: shipping.pending_shipments(star.order_heads(s, d), star.shipments(s, d), 50),
    "shipments_by_type": lambda s, d: shipping.shipments_by_type(star.shipments(s, d)),
    "shipment_ids_by_type": lambda s, d: shipping.shipment_ids_by_type(star.shipments(s, d)),
    "refresh_known_window": lambda s, d: orders.known_window(star.refreshed(s, d), star.order_heads(s, d), [F.desc("date_created"), F.asc("id")]).select("id", "position", "known"),
    "merge_refresh": merge_refresh,
    "merge_counters": lambda s, d: orders.change_counts(star.order_heads(s, d).drop("cancel_detail"), star.refreshed(s, d)),
    "merge_upsert": merge_upsert,
    "known_orders": lambda s, d: orders.known_orders(star.refreshed(s, d), star.order_heads(s, d)).select("id"),
    "unknown_orders": lambda s, d: orders.unknown_orders(star.refreshed(s, d), star.order_heads(s, d)).select("id"),
    "page_window": page_window,
    "civil_day_shift": civil_day_shift,
    "event_hours": event_hours,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
