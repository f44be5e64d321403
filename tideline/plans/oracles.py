"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from datetime import date

from tideline.operators.stock import BLOCK_IGNORED, FIRST_OF_KEY
from tideline.sources.star_schema import RULES

NOW = (date(1997, 1, 1), date(1997, 12, 31))
BEFORE = (date(1996, 1, 1), date(1996, 12, 31))


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def any_in_title(terms) -> str:
    return "(" + " OR ".join(f"contains(lower(title), '{t}')" for t in terms) + ")"


def rule_case(value) -> str:
    """A CASE over the rules: SKUs first, then titles, both by priority."""
    by_sku = "".join(f" WHEN trim(brand) IN ({quoted(r.sku)}) THEN {value(r, 'sku')}" for r in RULES if r.sku)
    by_title = ""
    for r in RULES:
        terms = [{"í": "i"}.get(c, c) for m in r.match for c in m.lower() + "\0"]
        hit = any_in_title([t for t in "".join(terms).split("\0") if t])
        hit += f" AND {any_in_title(r.tipo)}" if r.tipo else ""
        hit += f" AND NOT {any_in_title(r.exclui)}" if r.exclui else ""
        by_title += f" WHEN {hit} THEN {value(r, 'title')}"
    return f"CASE{by_sku}{by_title} END"


BASE = f"""
WITH o AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS total,
           CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'partially_refunded' ELSE 'cancelled' END AS status,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000-03:00') AS dc, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice END AS paid,
           CAST(o_orderkey // 2 AS VARCHAR) AS ship, 'C' || o_custkey AS buyer, o_orderpriority AS priority
    FROM orders
), s AS (SELECT * FROM o WHERE status IN ('paid', 'partially_refunded')
), l AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS oid, l_quantity AS q, l_extendedprice / l_quantity AS p, 'P' || l_partkey AS item,
           p_name || ' ' || p_type AS title, CASE WHEN l_partkey % 17 <> 0 THEN p_brand END AS brand,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice / l_quantity) AS pos
    FROM lineitem JOIN part ON l_partkey = p_partkey
), u AS (SELECT oid, sum(q) AS units FROM l GROUP BY oid
), now AS (SELECT s.*, coalesce(u.units, 0) AS units FROM s LEFT JOIN u ON u.oid = s.id WHERE d BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}'
), sl AS (SELECT * FROM s JOIN l ON l.oid = s.id
), sh AS (
    SELECT CAST(n AS VARCHAR) AS shipment_id, ['fulfillment', 'cross_docking', 'drop_off', 'self_service', 'xd_drop_off'][n % 5 + 1] AS logistic_type,
           CASE WHEN n % 7 = 0 THEN NULL WHEN n % 11 = 0 THEN 0.0 ELSE CAST(5 + n % 40 AS DOUBLE) END AS custo_frete
    FROM (SELECT DISTINCT o_orderkey // 2 AS n FROM orders)
), shared AS (
    SELECT *, p * q AS revenue, coalesce(brand, 'sem-sku-' || item) AS sku, sum(greatest(0, p * q)) OVER (PARTITION BY ship) AS ship_revenue FROM sl
), fl AS (
    SELECT shared.*, logistic_type, custo_frete, CASE WHEN custo_frete = 0 THEN 0 ELSE custo_frete * revenue / ship_revenue END AS freight
    FROM shared JOIN sh ON sh.shipment_id = shared.ship WHERE d BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}'
), pl0 AS (
    SELECT *, {rule_case(lambda r, via: f"'{r.id}'")} AS rule_id,
           {rule_case(lambda r, via: f"{r.custo_produto}::DOUBLE")} AS product_cost FROM fl
), pl AS (
    SELECT *, product_cost + CASE WHEN logistic_type = 'fulfillment' THEN 0 ELSE 3.0::DOUBLE END AS unit_cost, revenue * 0.148::DOUBLE AS fee,
           coalesce(freight, revenue * 0.144::DOUBLE) AS ship_fee FROM pl0
), c AS (SELECT *, unit_cost * q AS cost, revenue - fee - ship_fee - unit_cost * q AS margin FROM pl WHERE unit_cost IS NOT NULL
), ms AS (
    SELECT sku, arg_min(title, (length(title), k, pos)) AS label, sum(revenue) AS revenue, sum(fee) AS marketplace_fee, sum(ship_fee) AS shipping_fee, sum(cost) AS cost, sum(q) AS units,
           coalesce(sum(ship_fee) FILTER (WHERE freight IS NOT NULL), 0) AS freight_real, coalesce(sum(ship_fee) FILTER (WHERE freight IS NULL), 0) AS freight_estimated,
           sum(revenue) - sum(fee) - sum(ship_fee) - sum(cost) AS margin
    FROM c GROUP BY sku
), rk0 AS (
    SELECT sku, sum(revenue) AS revenue, sum(q) AS units, count(DISTINCT id) AS orders, count(DISTINCT item) AS items,
           coalesce(sum(revenue) FILTER (WHERE unit_cost IS NOT NULL), 0) AS costed_revenue, coalesce(sum(q) FILTER (WHERE unit_cost IS NOT NULL), 0) AS costed_units,
           coalesce(sum(q) FILTER (WHERE unit_cost IS NULL), 0) AS uncosted_units
    FROM pl GROUP BY sku
), rk AS (
    SELECT rk0.*, CASE WHEN costed_units = 0 THEN 'ausente' WHEN uncosted_units = 0 THEN 'total' ELSE 'parcial' END AS cost_coverage,
           ms.marketplace_fee, ms.shipping_fee, ms.cost, ms.margin, ms.margin / costed_revenue * 100 AS margin_pct
    FROM rk0 LEFT JOIN ms USING (sku)
), li AS (
    SELECT 'P' || p_partkey AS item_id, p_partkey AS k, p_name || ' ' || p_type AS title, ['active', 'paused', 'closed'][p_size % 3 + 1] AS status, p_retailprice AS price,
           CAST(p_size - 3 AS DOUBLE) AS quantity, CAST(p_partkey % 9 AS DOUBLE) AS sold_quantity, p_partkey % 2 = 0 AS premium,
           CASE WHEN p_partkey % 4 <> 0 THEN 'INV' || (p_partkey - p_partkey % 3) END AS inv, CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS brand, p_partkey % 5 < 2 AS is_full
    FROM part
), st AS (
    SELECT *, coalesce(brand, 'sem-sku-' || item_id) AS sku, greatest(quantity, 0) AS safe,
           CASE WHEN is_full THEN coalesce('inv:' || inv, 'sku:' || brand, 'item:' || item_id) ELSE 'inv:' || inv END AS key
    FROM li
)
"""


def consolidated_stock(value: str, where: str = "true", order: str = "q DESC, premium DESC, item_id") -> str:
    """CTEs ks and cs: stock by key, and by SKU."""
    return f"""
, ks AS (
    SELECT DISTINCT sku, is_full, key, max({value}) OVER w AS q, first_value(premium) OVER (PARTITION BY sku, is_full, key ORDER BY {order.replace("q DESC", value + " DESC")}) AS premium
    FROM st WHERE {where} WINDOW w AS (PARTITION BY sku, is_full, key)
), cs0 AS (
    SELECT sku, coalesce(sum(q) FILTER (WHERE is_full AND NOT premium), 0) AS full_classic, coalesce(sum(q) FILTER (WHERE is_full AND premium), 0) AS full_premium,
           coalesce(sum(q) FILTER (WHERE NOT is_full AND key IS NOT NULL), 0) AS own_by_id, max(greatest(q, 0)) FILTER (WHERE NOT is_full AND key IS NULL) AS bucket
    FROM ks GROUP BY sku
), cs AS (
    SELECT sku, CASE WHEN own_by_id <> 0 THEN own_by_id ELSE coalesce(bucket, 0) END AS own, full_classic, full_premium, full_classic + full_premium AS "full",
           own_by_id <> 0 AND bucket IS NOT NULL AS own_without_id_ignored FROM cs0
)
"""


def view_sql(view: str, value: str) -> str:
    where = "status = 'active'" if view == "own" else "is_full"
    order = "q DESC, premium DESC, item_id" if value == "safe" else "k"
    return f"""{BASE} {consolidated_stock(value, where, order)}
SELECT f.sku, f.listings, round(cs.{'own' if view == 'own' else '"full"'}, 2) AS stock, round(f.max_price, 2) AS max_price
FROM (SELECT sku, count(*) AS listings, max(price) AS max_price FROM st WHERE {where} GROUP BY sku) f JOIN cs USING (sku)"""


def summary_of(rows: str) -> str:
    return f"""{BASE} SELECT round(coalesce(sum(paid), 0), 2) AS revenue, count(*) AS orders, round(coalesce(sum(units), 0), 2) AS units,
    round(CASE WHEN count(*) > 0 THEN sum(paid) / count(*) END, 2) AS average_ticket FROM {rows}"""


def with_note(rows: str) -> str:
    return f"""SELECT *, CASE WHEN orders = 0 THEN 'sem_dados_no_periodo' ELSE '' END AS warnings FROM ({summary_of(rows)})"""


def between(a: date, b: date) -> str:
    return f"(SELECT s.*, coalesce(u.units, 0) AS units FROM s LEFT JOIN u ON u.oid = s.id WHERE d BETWEEN DATE '{a}' AND DATE '{b}')"


PENDING = "SELECT ship AS shipment_id, max(dc) AS newest FROM s WHERE ship NOT IN (SELECT shipment_id FROM sh WHERE custo_frete IS NOT NULL) GROUP BY ship"
REFRESHED = """, base AS (SELECT id, status, total, k FROM o), ref AS (
    SELECT id, status, total + CASE WHEN k % 40 = 0 THEN 10.0 ELSE 0.0 END AS total, k FROM o WHERE k % 20 = 0
    UNION ALL SELECT 'N' || id, status, total, k FROM o WHERE k % 50 = 1
)"""
TOP = "row_number() OVER (ORDER BY {} DESC, sku)"

def document_head(intent: str, metric: str, a: str, b: str, kind: str) -> str:
    """The query and coverage of a document, as columns."""
    return f"""'{intent}' AS query_intent, '{metric}' AS query_metric, '{a}' AS "query_period_fromYmd", '{b}' AS "query_period_toYmd", true AS coverage_available, '{kind}' AS coverage_type,
'{a}' AS "coverage_effectiveFromYmd", '{b}' AS "coverage_effectiveToYmd", (SELECT min(dc)[1:10] FROM o) AS "coverage_dataFromYmd", (SELECT max(dc)[1:10] FROM o) AS "coverage_dataToYmd\""""


YEAR = (str(NOW[0]), str(NOW[1]))
TICKET = "CASE WHEN count(*) > 0 THEN sum(paid) / count(*) END"
RANKED = f"""{BASE}, lt AS (SELECT sku, title, sum(revenue) AS r FROM pl GROUP BY ALL), lb AS (SELECT sku, title AS label FROM lt QUALIFY row_number() OVER (PARTITION BY sku ORDER BY r DESC, length(title), title) = 1),
tot AS (SELECT sum(revenue) AS revenue, sum(units) AS units, count(*) AS skus, count(*) FILTER (WHERE cost_coverage <> 'total') AS partly, coalesce(sum(revenue - costed_revenue) FILTER (WHERE cost_coverage <> 'total'), 0) AS uncosted,
    coalesce(sum(uncosted_units) FILTER (WHERE cost_coverage <> 'total'), 0) AS uncosted_units, coalesce(sum(revenue) FILTER (WHERE cost_coverage = 'total'), 0) AS covered FROM rk),
fr AS (SELECT coalesce(sum(ship_fee) FILTER (WHERE freight IS NOT NULL), 0) AS fr, coalesce(sum(ship_fee) FILTER (WHERE freight IS NULL), 0) AS fe, coalesce(sum(revenue) FILTER (WHERE freight IS NOT NULL), 0) AS rr, sum(revenue) AS ra FROM c)"""
TOTALS = """round(tot.revenue, 4) AS "periodTotalsAllProducts_productRevenue", round(tot.units, 4) AS "periodTotalsAllProducts_units", tot.skus AS "periodTotalsAllProducts_distinctSkus\""""

SQL = {
    "document_summary": f"""{BASE} SELECT {document_head('sales_summary', 'revenue', '1997-03-01', '1997-03-31', 'total')}, round(sum(paid), 4) AS result_revenue, count(*) AS result_orders, round({TICKET}, 4) AS "result_averageTicket", round(sum(units), 4) AS result_units, '' AS warnings
FROM {between(date(1997, 3, 1), date(1997, 3, 31))}""",
    "document_comparison": f"""{BASE}, a AS (SELECT coalesce(sum(paid), 0) AS r, count(*) AS n, coalesce(sum(units), 0) AS u FROM now), b AS (SELECT coalesce(sum(paid), 0) AS r, count(*) AS n, coalesce(sum(units), 0) AS u FROM {between(*BEFORE)})
SELECT {document_head('sales_comparison', 'revenue', *YEAR, 'total')}, '{BEFORE[0]}' AS "query_comparePeriod_fromYmd", '{BEFORE[1]}' AS "query_comparePeriod_toYmd",
round(a.r, 4) AS result_revenue, a.n AS result_orders, round(a.r / a.n, 4) AS "result_averageTicket", round(a.u, 4) AS result_units,
round(b.r, 4) AS compare_result_revenue, b.n AS compare_result_orders, round(b.r / b.n, 4) AS "compare_result_averageTicket", round(b.u, 4) AS compare_result_units,
true AS compare_coverage_available, 'total' AS compare_coverage_type, '{BEFORE[0]}' AS "compare_coverage_effectiveFromYmd", '{BEFORE[1]}' AS "compare_coverage_effectiveToYmd", (SELECT min(dc)[1:10] FROM o) AS "compare_coverage_dataFromYmd", (SELECT max(dc)[1:10] FROM o) AS "compare_coverage_dataToYmd",
round(a.r - b.r, 4) AS "compare_variation_revenueAbs", a.n - b.n AS "compare_variation_ordersAbs", round(a.u - b.u, 4) AS "compare_variation_unitsAbs", round((a.r - b.r) / b.r * 100, 4) AS "compare_variation_revenuePct",
round((a.n - b.n)::DOUBLE / b.n * 100, 4) AS "compare_variation_ordersPct", round((a.u - b.u) / b.u * 100, 4) AS "compare_variation_unitsPct", true AS compare_comparable, 1.0::DOUBLE AS "compare_coverageFraction_current", 1.0::DOUBLE AS "compare_coverageFraction_previous", '' AS warnings FROM a, b""",
    "document_margin": f"""{BASE}, t AS (SELECT coalesce(sum(revenue) FILTER (WHERE unit_cost IS NOT NULL), 0) AS r, sum(fee) FILTER (WHERE unit_cost IS NOT NULL) AS f, sum(ship_fee) FILTER (WHERE unit_cost IS NOT NULL) AS sf, sum(unit_cost * q) AS cost, sum(q) FILTER (WHERE unit_cost IS NOT NULL) AS u,
coalesce(sum(revenue) FILTER (WHERE unit_cost IS NULL), 0) AS wr, coalesce(sum(q) FILTER (WHERE unit_cost IS NULL), 0) AS wu, sum(ship_fee) FILTER (WHERE unit_cost IS NOT NULL AND freight IS NOT NULL) AS fr, sum(ship_fee) FILTER (WHERE unit_cost IS NOT NULL AND freight IS NULL) AS fe, sum(revenue) FILTER (WHERE unit_cost IS NOT NULL AND freight IS NOT NULL) AS rr FROM pl),
v AS (SELECT *, wr * 10 <= (r + wr) * 2 AS ok FROM t)
SELECT {document_head('sales_summary', 'margin', *YEAR, 'total')}, CASE WHEN ok THEN round(r, 4) END AS "result_productRevenue", CASE WHEN ok THEN round(f, 4) END AS "result_mlFee", CASE WHEN ok THEN round(sf, 4) END AS "result_shippingFee", CASE WHEN ok THEN round(cost, 4) END AS result_cost,
CASE WHEN ok THEN round(r - f - sf - cost, 4) END AS result_margin, CASE WHEN ok THEN round((r - f - sf - cost) / r * 100, 4) END AS "result_marginPct", CASE WHEN ok THEN round(u, 4) END AS result_units,
round(wr, 4) AS "noCost_productRevenue", round(wu, 4) AS "noCost_units", round(wr / (r + wr), 4) AS "noCost_revenueShare", CASE WHEN ok THEN round(fr, 4) END AS "shippingCost_actual", CASE WHEN ok THEN round(fe, 4) END AS "shippingCost_estimatedByPercent", CASE WHEN ok THEN round(rr / r, 4) END AS "shippingCost_revenueShareActual",
true AS "beforeAdvertising", true AS estimated, 'antes_de_publicidade' || CASE WHEN NOT ok THEN ',custo_insuficiente' WHEN wr > 0 THEN ',custo_parcial' ELSE '' END || CASE WHEN ok AND fe > 0 THEN ',frete_estimado' ELSE '' END AS warnings FROM v""",
    "document_ranking_margin": f"""{RANKED}
SELECT {document_head('sales_ranking', 'margin', *YEAR, 'total')}, 'margin' AS "query_rankBy", 20 AS query_limit, {TOTALS}, CAST({TOP.format('rk.margin')} AS INTEGER) AS item_rank, sku AS item_sku, label AS item_label, round(rk.units, 4) AS item_units, round(rk.revenue, 4) AS "item_productRevenue", orders AS item_orders,
true AS "item_costKnown", round(rk.cost, 4) AS item_cost, round(rk.margin, 4) AS item_margin, round(rk.margin_pct, 4) AS "item_marginPct", tot.partly AS "noCost_skus", round(tot.uncosted, 4) AS "noCost_productRevenue", round(tot.uncosted_units, 4) AS "noCost_units", round(tot.uncosted / tot.revenue, 4) AS "noCost_revenueShare",
round(tot.covered / tot.revenue, 4) AS "marginCoverage_revenueShareWithCost", tot.partly AS "marginCoverage_skusExcluded", round(fr.fr, 4) AS "shippingCost_actual", round(fr.fe, 4) AS "shippingCost_estimatedByPercent", round(rr / ra, 4) AS "shippingCost_revenueShareActual", true AS "beforeAdvertising", true AS estimated,
'antes_de_publicidade' || CASE WHEN tot.partly > 0 THEN ',custo_parcial' ELSE '' END || CASE WHEN ra > rr THEN ',frete_estimado' ELSE '' END || CASE WHEN tot.partly > 0 THEN ',ranking_margem_cobertura_parcial' ELSE '' END AS warnings
FROM rk JOIN lb USING (sku), tot, fr WHERE cost_coverage = 'total' QUALIFY {TOP.format('rk.margin')} <= 20""",
    "document_ranking_units": f"""{RANKED}
SELECT {document_head('sales_ranking', 'units', *YEAR, 'total')}, 'units' AS "query_rankBy", 3 AS query_limit, {TOTALS}, CAST({TOP.format('rk.units')} AS INTEGER) AS item_rank, sku AS item_sku, label AS item_label, round(rk.units, 4) AS item_units, round(rk.revenue, 4) AS "item_productRevenue", orders AS item_orders, '' AS warnings
FROM rk JOIN lb USING (sku), tot QUALIFY {TOP.format('rk.units')} <= 3""",
    "day_bounds": """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS civil_date FROM orders), b AS (
    SELECT civil_date, civil_date::TIMESTAMP AS s, civil_date::TIMESTAMP + INTERVAL '86399999 milliseconds' AS e FROM d
), o1 AS (
    SELECT *, s - (timezone('America/Sao_Paulo', timezone('UTC', s)) - s) AS s1, e - (timezone('America/Sao_Paulo', timezone('UTC', e)) - e) AS e1 FROM b
), o2 AS (
    SELECT civil_date, epoch_ms(s - (timezone('America/Sao_Paulo', timezone('UTC', s1)) - s1)) AS start_ms, epoch_ms(e - (timezone('America/Sao_Paulo', timezone('UTC', e1)) - e1)) AS end_ms FROM o1
)
SELECT civil_date, start_ms, end_ms, CAST((end_ms - start_ms + 1) // 3600000 AS INTEGER) AS hours FROM o2""",
    "calendar_of_sales": f"""{BASE}, w AS (SELECT CAST(date_trunc('week', d) AS DATE) AS monday, count(*) AS orders, round(sum(paid), 2) AS amount, max(d) AS newest FROM s WHERE d BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}' GROUP BY 1)
SELECT monday, orders, amount, newest, CAST(dayofweek(newest) AS INTEGER) AS weekday, CAST(date_trunc('month', newest) AS DATE) AS month_first, last_day(newest) AS month_last, CAST(date_trunc('month', newest) - INTERVAL 1 MONTH AS DATE) AS month_before,
monday - 7 AS week_before_first, monday - 7 + CAST(isodow(newest) - 1 AS INTEGER) AS week_before_last, least(CAST(date_trunc('month', newest) - INTERVAL 1 MONTH AS DATE) + CAST(day(newest) - 1 AS INTEGER), last_day(CAST(date_trunc('month', newest) - INTERVAL 1 MONTH AS DATE))) AS month_before_last FROM w""",
    "consolidated_by_group": f"""{BASE}, f AS (SELECT item, count(*) AS orders FROM s JOIN l ON l.oid = s.id WHERE pos = 1 GROUP BY item)
SELECT st.sku, arg_min(title, (length(title), k)) AS label, CAST(coalesce(sum(orders), 0) AS BIGINT) AS orders, round(coalesce(sum(safe) FILTER (WHERE status = 'active'), 0), 2) AS stock FROM st LEFT JOIN f ON f.item = st.item_id GROUP BY st.sku""",
    "cancel_labels": f"""{BASE} SELECT split_part(priority, '-', -1) AS "group", 'c' || k % 4 AS code, count(*) AS orders, round(sum(total), 2) AS amount, CASE WHEN k % 4 IN (1, 2) THEN 'motivo C' || k % 4 ELSE arg_min(priority, k) END AS description
FROM o WHERE status = 'cancelled' GROUP BY 1, 2, k % 4""",
    "sales_summary": summary_of("now"),
    "sales_summary_empty_period": summary_of(between(date(2031, 1, 1), date(2031, 1, 31))),
    "question_revenue": summary_of(between(date(1997, 3, 1), date(1997, 3, 31))),
    "question_rolling": with_note(between(date(1997, 11, 11), date(1997, 12, 10))),
    "question_empty": with_note(between(date(1995, 6, 18), date(1995, 6, 18))),
    "gross_net_period": f"""{BASE}, g AS (SELECT sum(total) AS x FROM now)
SELECT round(x, 2) AS gross, round(-x * 0.148::DOUBLE, 2) AS marketplace_fee, round(-x * 0.144::DOUBLE, 2) AS shipping_fee, round(x - x * 0.148::DOUBLE - x * 0.144::DOUBLE, 2) AS net, true AS estimated FROM g""",
    "sales_by_first_item": f"""{BASE} SELECT item AS item_id, count(*) AS orders, round(sum(q), 2) AS units, round(sum(paid), 2) AS revenue FROM now JOIN l ON l.oid = now.id WHERE pos = 1 GROUP BY item""",
    "sku_detail": f"""{BASE} SELECT id AS order_id, item AS item_id, brand AS sku, dc AS date, title, round(p, 2) AS unit_price, round(q, 2) AS quantity, round(p * q, 2) AS amount, status, buyer
FROM sl WHERE brand = 'Brand#13' AND d BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}'""",
    "sku_weekly": f"""{BASE}, w AS (SELECT brand AS sku, CAST(weekofyear(d) AS INTEGER) AS week, sum(q) AS n, sum(p * q) AS r FROM sl WHERE brand IS NOT NULL AND d BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}' GROUP BY ALL)
SELECT sku, round(sum(n) OVER (PARTITION BY sku), 2) AS units, round(sum(r) OVER (PARTITION BY sku), 2) AS revenue, week, round(n, 2) AS week_units FROM w""",
    "revenue_monthly_text": f"""{BASE} SELECT dc[1:7] AS month, round(sum(paid), 2) AS revenue FROM s GROUP BY 1""",
    "revenue_daily_month": f"""{BASE} SELECT CAST(day(d) AS INTEGER) AS day, round(sum(total), 2) AS revenue FROM s WHERE d BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' GROUP BY 1""",
    "cancel_reasons": f"""{BASE} SELECT split_part(priority, '-', -1) AS "group", 'sem_detalhe' AS code, count(*) AS orders, round(sum(total), 2) AS amount, arg_min(priority, k) AS description
FROM o WHERE status = 'cancelled' GROUP BY 1""",
    "units_by_item": f"""{BASE} SELECT item AS item_id, round(sum(q), 2) AS units FROM sl WHERE d BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}' GROUP BY item""",
    "status_counts": f"""{BASE} SELECT status, count(*) AS orders FROM o GROUP BY status""",
    "dedup_first_wins": f"""{BASE} SELECT id, round(total, 2) AS total_amount FROM o""",
    "slim_projection": f"""{BASE} SELECT id, status, coalesce(n, 0) AS lines, buyer AS nickname, ship AS shipment, round(paid, 2) AS paid_amount FROM o LEFT JOIN (SELECT oid, count(*) AS n FROM l GROUP BY oid) ON oid = id""",
    "coverage_window": f"""{BASE} SELECT min(dc) AS oldest_date, max(dc) AS newest_date FROM o""",
    "period_clip": f"""{BASE}, b AS (SELECT min(d) AS d0 FROM o), r AS (SELECT s.*, coalesce(u.units, 0) AS units FROM s LEFT JOIN u ON u.oid = s.id WHERE d BETWEEN DATE '1994-01-01' AND DATE '1995-06-30')
SELECT round(sum(paid), 2) AS revenue, count(*) AS orders, round(sum(units), 2) AS units, round(sum(paid) / count(*), 2) AS average_ticket, 'parcial' AS coverage, (SELECT d0 FROM b) AS covered_from, DATE '1995-06-30' AS covered_to FROM r""",
    "compare_periods": f"""{BASE}, a AS (SELECT coalesce(sum(paid), 0) AS r, count(*) AS n, coalesce(sum(units), 0) AS u FROM now), b AS (SELECT coalesce(sum(paid), 0) AS r, count(*) AS n, coalesce(sum(units), 0) AS u FROM {between(*BEFORE)})
SELECT round(a.r, 2) AS revenue_now, a.n AS orders_now, round(a.u, 2) AS units_now, round(b.r, 2) AS revenue_before, b.n AS orders_before, round(b.u, 2) AS units_before,
       round(a.r / a.n, 2) AS ticket_now, round(b.r / b.n, 2) AS ticket_before, round((a.r - b.r) / b.r * 100, 2) AS revenue_change, round((a.n - b.n)::DOUBLE / b.n * 100, 2) AS orders_change,
       round((a.u - b.u) / b.u * 100, 2) AS units_change, round((a.r / a.n - b.r / b.n) / (b.r / b.n) * 100, 2) AS ticket_change FROM a, b""",
    "fixed_windows": f"""{BASE}, w AS (SELECT * FROM (VALUES ('hoje', DATE '1997-12-10', DATE '1997-12-10'), ('ultimos7', DATE '1997-12-04', DATE '1997-12-10'), ('mesAtual', DATE '1997-12-01', DATE '1997-12-10'), ('historico', DATE '{NOW[0]}', DATE '{NOW[1]}')) t(win, a, b)),
r AS (SELECT s.*, coalesce(u.units, 0) AS units FROM s LEFT JOIN u ON u.oid = s.id)
SELECT win AS "window", round(coalesce(sum(paid), 0), 2) AS revenue, count(id) AS orders, round(coalesce(sum(units), 0), 2) AS units, round(CASE WHEN count(id) > 0 THEN sum(paid) / count(id) END, 2) AS average_ticket
FROM w LEFT JOIN r ON d BETWEEN a AND b GROUP BY win""",
    "cost_rule_match": f"""{BASE} SELECT coalesce({rule_case(lambda r, via: f"'{r.id}'")}, 'none') AS rule_id, coalesce({rule_case(lambda r, via: f"'{via}'")}, 'none') AS via, count(*) AS lines FROM l GROUP BY 1, 2""",
    "rule_table_match": """WITH r AS (
    SELECT p_partkey AS ordem, 'R' || p_partkey AS rule_id, (100 + p_partkey % 50)::DOUBLE AS cost, CASE WHEN p_partkey % 97 = 0 THEN p_brand END AS sku,
           lower(split_part(p_name, ' ', -1) || ' ' || p_type) AS m1, '#' || p_partkey AS m2, CASE WHEN p_partkey % 3 <> 0 THEN split_part(p_name, ' ', 1) END AS tipo, CASE WHEN p_partkey % 5 <> 0 THEN p_name[2:4] END AS exclui FROM part
), t AS (
    SELECT DISTINCT lower(p_name || ' ' || p_type) AS t FROM part
), h AS (
    SELECT t, min(ordem) AS ordem FROM t JOIN r ON (contains(t, m1) OR contains(t, m2)) AND (tipo IS NULL OR contains(t, tipo)) AND (exclui IS NULL OR NOT contains(t, exclui)) GROUP BY t
), k AS (SELECT sku, min(ordem) AS ordem FROM r WHERE sku IS NOT NULL GROUP BY sku)
SELECT 'P' || p_partkey AS item_id, r.rule_id, r.cost AS product_cost, CASE WHEN k.ordem IS NOT NULL THEN 'sku' WHEN h.ordem IS NOT NULL THEN 'title' END AS via
FROM part LEFT JOIN k ON k.sku = CASE WHEN p_partkey % 17 <> 0 THEN p_brand END LEFT JOIN h ON h.t = lower(p_name || ' ' || p_type) LEFT JOIN r ON r.ordem = coalesce(k.ordem, h.ordem)""",
    "kit_multiplier": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 30 BETWEEN 2 AND 24 THEN p_partkey % 30 ELSE 1 END AS INTEGER) AS bottles, p_name AS normal FROM part",
    "unit_cost": f"""{BASE} SELECT rule_id, logistic_type, round(min(unit_cost), 2) AS low, round(max(unit_cost), 2) AS high, count(*) AS lines FROM c GROUP BY 1, 2""",
    "shipment_base": f"""{BASE} SELECT ship AS shipment_id, round(sum(greatest(0, p * q)), 2) AS revenue, round(sum(greatest(0, q)), 2) AS units FROM sl GROUP BY ship""",
    "freight_share": f"""{BASE} SELECT sku, round(coalesce(sum(freight), 0), 2) AS freight, count(freight) AS lines_known, count(*) AS lines FROM fl GROUP BY sku""",
    "freight_coverage": f"""{BASE} SELECT count(DISTINCT ship) AS shipments, count(DISTINCT ship) FILTER (WHERE custo_frete IS NOT NULL) AS resolved, count(DISTINCT ship) FILTER (WHERE custo_frete IS NULL) AS pending,
round(count(DISTINCT ship) FILTER (WHERE custo_frete IS NOT NULL) / count(DISTINCT ship)::DOUBLE, 4) AS fraction FROM s JOIN sh ON shipment_id = ship""",
    "margin_total": f"""{BASE}, t AS (SELECT sum(revenue) AS revenue, sum(fee) AS marketplace_fee, sum(ship_fee) AS shipping_fee, sum(cost) AS cost, sum(q) AS units, sum(revenue) FILTER (WHERE freight IS NOT NULL) AS real, count(*) FILTER (WHERE freight IS NULL) AS estimated FROM c),
x AS (SELECT coalesce(sum(revenue), 0) AS without FROM pl WHERE unit_cost IS NULL), y AS (SELECT *, without / (revenue + without) AS share, revenue - marketplace_fee - shipping_fee - cost AS margin FROM t, x), z AS (SELECT *, share <= 0.2 AS available FROM y)
SELECT CASE WHEN available THEN round(revenue, 2) END AS revenue, CASE WHEN available THEN round(marketplace_fee, 2) END AS marketplace_fee, CASE WHEN available THEN round(shipping_fee, 2) END AS shipping_fee, CASE WHEN available THEN round(cost, 2) END AS cost,
       CASE WHEN available THEN round(units, 2) END AS units, CASE WHEN available THEN round(margin, 2) END AS margin, CASE WHEN available THEN round(margin / revenue * 100, 2) END AS margin_pct, round(without, 2) AS revenue_without_cost,
       round(share, 4) AS without_cost, CASE WHEN available THEN round(real / revenue, 4) END AS real_freight, available,
       concat_ws(',', 'antes_de_publicidade', CASE WHEN NOT available THEN 'custo_insuficiente' WHEN without > 0 THEN 'custo_parcial' END, CASE WHEN available AND estimated > 0 THEN 'frete_estimado' END) AS warnings FROM z""",
    "margin_by_sku": f"""{BASE} SELECT sku, label, round(revenue, 2) AS revenue, round(marketplace_fee, 2) AS marketplace_fee, round(shipping_fee, 2) AS shipping_fee, round(cost, 2) AS cost, round(units, 2) AS units,
round(freight_real, 2) AS freight_real, round(freight_estimated, 2) AS freight_estimated, round(margin, 2) AS margin, round(margin / revenue * 100, 2) AS margin_pct FROM ms""",
    "margin_rollup": f"""{BASE}, r AS (SELECT sku, CASE WHEN unit_cost IS NOT NULL THEN revenue ELSE 0 END AS r, CASE WHEN unit_cost IS NOT NULL THEN unit_cost * q ELSE 0 END AS cost, CASE WHEN unit_cost IS NOT NULL THEN revenue - fee - ship_fee - unit_cost * q ELSE 0 END AS m, CASE WHEN unit_cost IS NULL THEN revenue ELSE 0 END AS w FROM pl)
SELECT grouping(sku) = 1 AS is_total, sku, round(sum(r), 2) AS revenue, round(sum(cost), 2) AS cost, round(sum(m), 2) AS margin, round(sum(w), 2) AS revenue_without_cost FROM r GROUP BY ROLLUP (sku)""",
    "margin_best": f"""{BASE} SELECT sku, round(margin, 2) AS margin FROM ms ORDER BY ms.margin DESC, sku LIMIT 5""",
    "margin_worst": f"""{BASE} SELECT sku, round(margin, 2) AS margin FROM ms ORDER BY ms.margin, sku DESC LIMIT 5""",
    "no_cost_report": f"""{BASE} SELECT title, round(sum(revenue), 2) AS revenue, round(sum(q), 2) AS units FROM pl WHERE unit_cost IS NULL GROUP BY title""",
    "ranking_revenue": f"""{BASE}, lt AS (SELECT sku, title, sum(revenue) AS r FROM pl GROUP BY ALL), lb AS (SELECT sku, title AS label FROM lt QUALIFY row_number() OVER (PARTITION BY sku ORDER BY r DESC, length(title), title) = 1)
SELECT CAST({TOP.format('revenue')} AS INTEGER) AS position, sku, label, round(revenue, 2) AS revenue, round(units, 2) AS units, orders, items, cost_coverage FROM rk JOIN lb USING (sku) QUALIFY {TOP.format('rk.revenue')} <= 5""",
    "ranking_units": f"""{BASE} SELECT CAST({TOP.format('rk.units')} AS INTEGER) AS position, sku, round(units, 2) AS units, orders FROM rk QUALIFY {TOP.format('rk.units')} <= 10""",
    "ranking_margin": f"""{BASE} SELECT CAST({TOP.format('rk.margin')} AS INTEGER) AS position, sku, round(margin, 2) AS margin, round(margin_pct, 2) AS margin_pct FROM rk WHERE cost_coverage = 'total' QUALIFY {TOP.format('rk.margin')} <= 20""",
    "ranking_everything": f"""{BASE} SELECT CAST({TOP.format('rk.revenue')} AS INTEGER) AS position, sku, round(revenue, 2) AS revenue, cost_coverage, round(margin, 2) AS margin FROM rk""",
    "margin_coverage": f"""{BASE} SELECT round(coalesce(sum(revenue) FILTER (WHERE cost_coverage = 'total'), 0), 2) AS covered_revenue, round(sum(revenue), 2) AS revenue, count(*) FILTER (WHERE cost_coverage <> 'total') AS excluded,
round(coalesce(sum(revenue) FILTER (WHERE cost_coverage = 'total'), 0) / sum(revenue), 4) AS fraction FROM rk""",
    "margin_route_totals": f"""{BASE}, t AS (SELECT sum(revenue) AS revenue, sum(units) AS units, sum(costed_revenue) AS costed_revenue, sum(marketplace_fee) AS marketplace_fee, sum(shipping_fee) AS shipping_fee, sum(cost) AS cost, sum(margin) AS margin, count(*) AS skus FROM rk)
SELECT round(revenue, 2) AS revenue, round(units, 2) AS units, round(costed_revenue, 2) AS costed_revenue, round(marketplace_fee, 2) AS marketplace_fee, round(shipping_fee, 2) AS shipping_fee, round(cost, 2) AS cost, round(margin, 2) AS margin, skus,
       round(revenue - marketplace_fee - shipping_fee, 2) AS net_revenue, round(margin / costed_revenue * 100, 2) AS margin_pct FROM t""",
    "catalog_counts": f"""{BASE} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'paused') AS paused, count(*) FILTER (WHERE status = 'closed') AS closed FROM li""",
    "slim_listings": f"""{BASE} SELECT item_id AS id, title, status, round(price, 2) AS price, round(quantity, 2) AS available_quantity, inv AS inventory_id FROM li""",
    "consolidated": f"""{BASE} {consolidated_stock('safe')}, f AS (SELECT item, count(*) AS orders, sum(total) AS gross, sum(q) AS units FROM s JOIN l ON l.oid = s.id WHERE pos = 1 GROUP BY item)
SELECT st.sku, arg_min(title, (length(title), k)) AS label, count(*) AS listings, round(sum(sold_quantity), 2) AS sold, CAST(coalesce(sum(orders), 0) AS BIGINT) AS orders, round(coalesce(avg(price) FILTER (WHERE status = 'active' AND price > 0), 0), 2) AS average_listing_price,
       round(coalesce(sum(units), 0), 2) AS units, round(coalesce(sum(gross) / sum(units), 0), 2) AS average_sold_price, round(any_value(cs.own + cs."full"), 2) AS stock
FROM st LEFT JOIN f ON f.item = st.item_id JOIN cs ON cs.sku = st.sku GROUP BY st.sku""",
    "stock_own_legacy": view_sql("own", "quantity"),
    "stock_own_safe": view_sql("own", "safe"),
    "stock_full_safe": view_sql("full", "safe"),
    "stock_consolidated": f"""{BASE} {consolidated_stock('safe')} SELECT sku, own, full_classic, full_premium, "full", own + "full" AS total, own_without_id_ignored FROM cs""",
    "stock_audit_safe": f"""{BASE}, a AS (SELECT *, coalesce(key, 'sem-inventory') AS dedup_key, NOT is_full AND key IS NULL AND coalesce(bool_or(NOT is_full AND key IS NOT NULL AND safe <> 0) OVER (PARTITION BY sku), false) AS dropped FROM st)
SELECT sku, item_id, CASE WHEN is_full THEN 'full' ELSE 'proprio' END AS origin, dedup_key, quantity AS original, safe AS quantity, n = 1 AND NOT dropped AS considered,
       CASE WHEN dropped THEN '{BLOCK_IGNORED}'
            WHEN n = 1 AND size = 1 THEN CASE WHEN is_full THEN 'Único anúncio da chave ' || dedup_key || ' — saldo considerado.' WHEN key IS NULL THEN 'Único anúncio próprio sem inventory_id — saldo considerado.' ELSE 'Saldo próprio independente (inventory_id distinto soma).' END
            WHEN n = 1 THEN 'Vencedor determinístico' || CASE WHEN is_full THEN ' da chave ' || dedup_key ELSE ' (' || dedup_key || ')' END || '.'
            ELSE 'Deduplicado' || CASE WHEN is_full THEN ' na chave ' || dedup_key ELSE ' (' || dedup_key || ')' END || ': perdeu para ' || wi || ' por ' ||
                 CASE WHEN wq <> safe THEN 'saldo maior (' || CAST(wq AS BIGINT) || ' > ' || CAST(safe AS BIGINT) || ')' WHEN is_full AND wp <> premium THEN 'empate de saldo resolvido por premium'
                      ELSE 'empate de saldo' || CASE WHEN is_full THEN ' e classe' ELSE '' END || ' resolvido por itemId lexical (' || wi || ' < ' || item_id || ')' END || '.' END AS reason
FROM (SELECT *, row_number() OVER g AS n, count(*) OVER (PARTITION BY sku, is_full, dedup_key) AS size, first_value(item_id) OVER g AS wi, first_value(safe) OVER g AS wq, first_value(premium) OVER g AS wp
      FROM a WINDOW g AS (PARTITION BY sku, is_full, dedup_key ORDER BY safe DESC, (is_full AND premium) DESC, item_id))""",
    "stock_audit_legacy": f"""{BASE}, la AS (SELECT *, CASE WHEN is_full THEN 'full' WHEN key IS NOT NULL THEN 'inv' ELSE 'none' END AS kind, coalesce(key, 'sem-inventory') AS dedup_key FROM st),
lb AS (SELECT *, max(quantity) OVER (PARTITION BY sku, kind, dedup_key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM la),
lc AS (SELECT *, before IS NULL AS first, CASE WHEN kind = 'none' THEN greatest(before, 0) ELSE before END AS best, before IS NULL OR quantity > CASE WHEN kind = 'none' THEN greatest(before, 0) ELSE before END AS record FROM lb),
ld AS (SELECT *, CASE WHEN record THEN lead(item_id) OVER w END AS ni, CASE WHEN record THEN lead(quantity) OVER w END AS nq FROM lc WINDOW w AS (PARTITION BY sku, kind, dedup_key, record ORDER BY k)),
le AS (SELECT *, kind = 'none' AND coalesce(sum(quantity) FILTER (WHERE kind = 'inv' AND record AND ni IS NULL) OVER (PARTITION BY sku), 0) <> 0 AS dropped FROM ld)
SELECT sku, item_id, CASE kind WHEN 'full' THEN 'full' WHEN 'inv' THEN 'proprio_com_inventory' ELSE 'proprio_sem_inventory' END AS origin, dedup_key, quantity AS original, quantity, record AND ni IS NULL AND NOT dropped AS considered, k AS ordinal,
       CASE WHEN dropped THEN '{BLOCK_IGNORED}'
            WHEN NOT record THEN CASE kind WHEN 'none' THEN 'Espelho sem inventory_id com saldo menor ou igual — não somado.'
                 ELSE CASE kind WHEN 'full' THEN 'Deduplicado: mesma chave ' || dedup_key || ' já considerada' ELSE 'Deduplicado: mesmo inventory_id já considerado' END || ' com saldo ' || CAST(best AS BIGINT) || ' (>= ' || CAST(quantity AS BIGINT) || ').' END
            WHEN ni IS NOT NULL THEN CASE kind WHEN 'none' THEN 'Espelho sem inventory_id: venceu ' || ni || ' com saldo maior.'
                 ELSE CASE kind WHEN 'full' THEN 'Deduplicado: mesma chave ' || dedup_key ELSE 'Deduplicado: mesmo inventory_id' END || '; venceu ' || ni || ' com saldo maior (' || CAST(nq AS BIGINT) || ' > ' || CAST(quantity AS BIGINT) || ').' END
            WHEN first THEN CASE kind WHEN 'full' THEN '{FIRST_OF_KEY["full"]}' WHEN 'inv' THEN '{FIRST_OF_KEY["inv"]}' ELSE '{FIRST_OF_KEY["none"]}' END
            ELSE CASE kind WHEN 'full' THEN 'Mesma chave ' || dedup_key || ': saldo maior vence; classe permanece a do primeiro anúncio (quirk legado, não determinístico).'
                 WHEN 'inv' THEN 'Mesmo inventory_id: saldo maior vence.' ELSE 'Espelhos sem inventory_id compartilham o mesmo saldo — maior saldo considerado.' END END AS reason
FROM le""",
    "dashboard_parts": f"""{BASE}, r AS (SELECT s.*, coalesce(u.units, 0) AS units FROM s LEFT JOIN u ON u.oid = s.id),
w AS (SELECT * FROM (VALUES ('hoje', DATE '1997-12-10', DATE '1997-12-10'), ('ultimos7', DATE '1997-12-04', DATE '1997-12-10'), ('mesAtual', DATE '1997-12-01', DATE '1997-12-10'), ('historico', DATE '{NOW[0]}', DATE '{NOW[1]}')) t(win, a, b)),
gross AS (SELECT d, coalesce(nullif(paid, 0), total) AS g FROM s),
x AS (
    SELECT 'window' AS part, win AS key, units, paid AS amount FROM w JOIN r ON d BETWEEN a AND b
    UNION ALL SELECT 'period', 'total', NULL, g FROM gross WHERE d BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}'
    UNION ALL SELECT 'reputation', 'total', NULL, g FROM gross WHERE d BETWEEN DATE '1997-10-11' AND DATE '1997-12-10'
    UNION ALL SELECT 'item', item, q, paid FROM s JOIN l ON l.oid = s.id WHERE pos = 1 AND d BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}'
    UNION ALL SELECT 'stock', item, q, NULL FROM sl WHERE d BETWEEN DATE '1997-11-10' AND DATE '1997-12-10'
    UNION ALL SELECT 'month', dc[1:7], NULL, paid FROM s
    UNION ALL SELECT 'status', status, NULL, NULL FROM o WHERE status <> 'cancelled'
)
SELECT part, key, count(*) AS orders, round(coalesce(sum(units), 0), 2) AS units, round(coalesce(sum(amount), 0), 2) AS amount FROM x GROUP BY ALL""",
    "stock_alerts": f"""{BASE} {consolidated_stock('safe')} SELECT sku, 'saldo_negativo_normalizado' AS kind, item_id FROM st WHERE quantity < 0
UNION ALL SELECT sku, 'proprio_sem_inventory_ignorado', NULL FROM cs WHERE own_without_id_ignored""",
    "stock_class": f"""{BASE} {consolidated_stock('safe', "status = 'active'")}, ui AS (SELECT item, sum(q) AS n FROM sl WHERE d BETWEEN DATE '1997-11-10' AND DATE '1997-12-10' GROUP BY item),
f AS (SELECT sku, coalesce(sum(n), 0) AS sold FROM st LEFT JOIN ui ON item = item_id WHERE status = 'active' GROUP BY sku), v AS (SELECT f.sku, cs.own AS stock, sold, round(sold / 30, 2) AS velocity FROM f JOIN cs USING (sku)),
x AS (SELECT *, CASE WHEN velocity > 0 THEN floor(stock / velocity + 0.5) END AS days_of_stock FROM v)
SELECT sku, stock, sold, velocity, days_of_stock, CASE WHEN days_of_stock IS NULL THEN 'semvenda' WHEN days_of_stock < 30 THEN 'ruptura' WHEN days_of_stock < 90 THEN 'alerta' WHEN days_of_stock <= 365 THEN 'ok' ELSE 'excesso' END AS class FROM x""",
    "pending_shipments": f"{BASE} {PENDING}",
    "pending_counts": f"""{BASE}, x AS (SELECT count(DISTINCT ship) AS shipments, count(DISTINCT ship) FILTER (WHERE custo_frete IS NOT NULL) AS resolved FROM s JOIN sh ON shipment_id = ship)
SELECT shipments, resolved, least(shipments - resolved, 50) AS batch, greatest(0, shipments - resolved - 50) AS remaining FROM x""",
    "pending_batch": f"{BASE} {PENDING} ORDER BY newest DESC, shipment_id LIMIT 50",
    "shipments_by_type": f"{BASE} SELECT logistic_type, count(*) AS shipments FROM sh GROUP BY 1",
    "shipment_ids_by_type": f"{BASE} SELECT logistic_type, row_number() OVER (PARTITION BY logistic_type ORDER BY shipment_id) AS place, shipment_id FROM sh",
    "refresh_known_window": f"""{BASE} {REFRESHED}, r AS (SELECT ref.id, row_number() OVER (ORDER BY dc DESC, ref.id) - 1 AS position, ref.id IN (SELECT id FROM base) AS known FROM ref JOIN o USING (k)),
x AS (SELECT *, sum(CAST(known AS INTEGER)) OVER (ORDER BY position) AS seen FROM r), e AS (SELECT (position // 50 + 1) * 50 AS stop FROM x WHERE known AND seen = 250)
SELECT id, position, known FROM r WHERE position < coalesce((SELECT max(stop) FROM e), 1000000000000)""",
    "merge_refresh": f"""{BASE} {REFRESHED}, m AS (SELECT * FROM ref UNION ALL SELECT * FROM base WHERE id NOT IN (SELECT id FROM ref)) SELECT status, count(*) AS orders, round(sum(total), 2) AS amount FROM m GROUP BY 1""",
    "merge_counters": f"""{BASE} {REFRESHED} SELECT count(*) FILTER (WHERE base.id IS NULL) AS "new", count(*) FILTER (WHERE base.total <> ref.total) AS changed, count(*) FILTER (WHERE base.total = ref.total) AS same FROM ref LEFT JOIN base USING (id)""",
    "merge_upsert": f"""{BASE}, m AS (SELECT logistic_type, CASE WHEN CAST(shipment_id AS BIGINT) % 14 = 0 THEN 9.5 ELSE custo_frete END AS c FROM sh) SELECT logistic_type, count(*) AS shipments, count(c) AS known, round(coalesce(sum(c), 0), 2) AS cost FROM m GROUP BY 1""",
    "known_orders": f"{BASE} SELECT id FROM o WHERE k % 20 = 0",
    "unknown_orders": f"{BASE} SELECT 'N' || id AS id FROM o WHERE k % 50 = 1",
    "page_window": f"{BASE} SELECT id, status, k AS ordinal, round(total, 2) AS total_amount FROM o WHERE k BETWEEN 400 AND 599",
    "civil_day_shift": """SELECT CAST(timezone('America/Sao_Paulo', timezone('UTC', o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)))) AS DATE) AS civil_day, count(*) AS orders FROM orders GROUP BY 1""",
    "event_hours": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 2) AS amount FROM events GROUP BY 1, 2",
}
SQL["question_comparison"] = SQL["compare_periods"]
SQL["question_margin"] = f"SELECT revenue, cost, margin, available, warnings FROM ({SQL['margin_total']})"
SQL["question_ranking"] = f"""{BASE}, lt AS (SELECT sku, title, sum(revenue) AS r FROM pl GROUP BY ALL), lb AS (SELECT sku, title AS label FROM lt QUALIFY row_number() OVER (PARTITION BY sku ORDER BY r DESC, length(title), title) = 1)
SELECT CAST({TOP.format('rk.units')} AS INTEGER) AS position, sku, label, round(revenue, 2) AS revenue, round(units, 2) AS units, orders FROM rk JOIN lb USING (sku) QUALIFY {TOP.format('rk.units')} <= 3"""
