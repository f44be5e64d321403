"""Places in a global order, the legacy audit, the dashboard in one pass, and shipments by type."""

import random
from datetime import date

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.test_texts_and_stock import listing, listings
from tideline.functions import places
from tideline.operators import dashboard, ranking, sales, shipping, stock
from tideline.sources import star_schema


def test_numbers_are_those_of_one_window(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([1.0, 2.0, r.lognormvariate(0, 2.5), None]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(6)
    found = places.numbered(df, [F.desc("v"), F.asc("id")], ranges=7).collect()
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
    assert [(x.id, x.position) for x in found] == [(w[2], i + 1) for i, w in enumerate(want)]
    found = places.numbered(df, [F.asc("id")], ["g"], "n", ranges=7)
    groups = {}
    for g, _, i in sorted(rows, key=lambda x: x[2]):
        groups.setdefault(g, []).append(i)
    assert {(x.g, x.n, x.id) for x in found.collect()} == {(g, k + 1, i) for g, ids in groups.items() for k, i in enumerate(ids)}
    assert found.columns == ["g", "v", "id", "n"] and places.numbered(df.limit(0), [F.asc("id")]).count() == 0


def test_ranges_of_skewed_values_are_even(spark):
    values = spark.range(40_000).select(F.exp(F.randn(3) * 2.5).alias("v"), "id")
    sizes = [x["count"] for x in places.in_ranges(values, [F.desc("v"), F.asc("id")], 16).groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sorted(sizes)[8]


def test_many_counts_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(places, "MOST_COUNTS", 3)
    df = spark.range(500).select((F.col("id") % 50).alias("g"), "id")
    assert {(x.g, x.position, x.id) for x in places.numbered(df, [F.asc("id")], ["g"]).collect()} == {(i % 50, i // 50 + 1, i) for i in range(500)}


def test_shipments_of_a_hot_type(spark):
    rows = spark.range(2000).select(F.format_string("%05d", F.col("id")).alias("shipment_id"), F.when(F.col("id") % 10 != 0, "hot").otherwise("cold").alias("logistic_type"), F.lit(1.0).alias("custo_frete"))
    found = shipping.shipment_ids_by_type(rows.repartition(5)).collect()
    hot = [x.shipment_id for x in found if x.logistic_type == "hot"]
    assert len(hot) == 1800 and hot == sorted(hot) and [x.place for x in found if x.logistic_type == "cold"] == list(range(1, 201))


def legacy(spark, *rows):
    made = [listing(*r, ordinal=i) for i, r in enumerate(rows)]
    return [(x.item_id, x.considered, x.reason) for x in stock.legacy_audit(stock.stock_lines(listings(spark, *made), stock.LEGACY)).orderBy("ordinal").collect()]


def test_legacy_reasons_by_arrival(spark):
    a, b, c = legacy(spark, ("A", "S", "k", 4.0, True), ("B", "S", "k", 9.0, True), ("C", "S", "k", 9.0, True))
    assert a == ("A", False, "Deduplicado: mesma chave inv:k; venceu B com saldo maior (9 > 4).")
    assert b == ("B", True, "Mesma chave inv:k: saldo maior vence; classe permanece a do primeiro anúncio (quirk legado, não determinístico).")
    assert c == ("C", False, "Deduplicado: mesma chave inv:k já considerada com saldo 9 (>= 9).")
    b, a = legacy(spark, ("B", "S", "k", 9.0, True), ("A", "S", "k", 4.0, True))
    assert b == ("B", True, "Primeiro anúncio da chave — saldo considerado.") and a[2].endswith("com saldo 9 (>= 4).")


def test_legacy_own_stock(spark):
    a, b, c, d = legacy(spark, ("A", "S", "x", 1.0, False), ("B", "S", "x", 3.0, False), ("C", "S", "y", -3.0, False), ("D", "S", None, 5.0, False))
    assert a[1:] == (False, "Deduplicado: mesmo inventory_id; venceu B com saldo maior (3 > 1).") and b[1:] == (True, "Mesmo inventory_id: saldo maior vence.")
    # 3 and -3 cancel each other, so stock without an inventory id stands in.
    assert c[1] and d[1:] == (True, "Espelhos sem inventory_id compartilham o mesmo saldo — primeiro anúncio considerado.")
    a, b, c = legacy(spark, ("A", "S", None, -2.0, False), ("B", "S", None, 0.0, False), ("C", "S", None, 2.0, False))
    assert [x[1] for x in (a, b, c)] == [False, False, True] and a[2] == "Espelho sem inventory_id: venceu C com saldo maior."
    assert b[2] == "Espelho sem inventory_id com saldo menor ou igual — não somado." and c[2].endswith("maior saldo considerado.")
    assert {x[2] for x in legacy(spark, ("A", "S", "x", 1.0, False), ("B", "S", None, 3.0, False)) if not x[1]} == {stock.BLOCK_IGNORED}


def test_the_dashboard_reads_orders_once(spark):
    period, today = (date(1997, 1, 1), date(1997, 12, 31)), date(1997, 12, 10)
    nested = star_schema.orders(spark, SMALL)
    plan = dashboard.dashboard_rows(nested, period, today, *period)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 1
    parts = dashboard.dashboard(nested, period, today, *period)
    back = lambda n: (date.fromordinal(today.toordinal() - n), today)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(parts["windows"].select("window", "revenue", "orders", "units", "average_ticket")) == rows(sales.windows_summary(nested, dashboard.fixed_windows(today, *period)))
    assert rows(parts["period"]) == rows(sales.gross_and_net(nested, *period)) and rows(parts["reputation"]) == rows(sales.gross_and_net(nested, *back(60)))
    assert rows(parts["by_item"]) == rows(sales.sales_by_first_item(nested, *period)) and rows(parts["stock_units"]) == rows(sales.units_by_item(nested, *back(30)))
    assert rows(parts["by_month"]) == rows(sales.revenue_by_text_month(nested)) and rows(parts["by_status"]) == rows(sales.status_counts(nested).where("status <> 'cancelled'"))


def test_a_whole_ranking_is_sorted(spark):
    lines = spark.range(900).select(F.concat(F.lit("s"), F.col("id") % 300).alias("sku"), F.lit("t").alias("title"), F.lit("i").alias("item_id"), F.exp(F.randn(1) * 2).alias("revenue"), F.lit(1.0).alias("quantity"), F.lit(True).alias("first_of_order"), *[F.lit(1.0).alias(c) for c in ("unit_cost", "marketplace_fee", "shipping_fee", "cost")])
    found = ranking.ranking(lines, everything=True).collect()
    assert [r.position for r in found] == list(range(1, 301)) and all(a.revenue >= b.revenue for a, b in zip(found, found[1:], strict=False))


def test_lines_move_once_for_windows_and_shipments(spark):
    from tideline.operators import lines

    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(before, ("-1", "false"), strict=True):
            spark.conf.set(c, v)
        rows = spark.createDataFrame([("o1", 1, 0, "paid", "s1", None, "i", "t", "A", 1.0, 2.0), ("o2", 2, 0, "paid", None, "x", "i", "t", None, 1.0, 2.0)], "order_id string, ordinal long, pos int, status string, shipment_id string, own_logistic_type string, item_id string, title string, seller_sku string, quantity double, unit_price double")
        ships = spark.createDataFrame([("s1", "drop_off", 4.0), ("o2", "drop_off", 9.0)], "shipment_id string, logistic_type string, custo_frete double")
        found = lines.sale_lines(rows, ships)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(__key") == 1 and plan.count("Exchange") == 2
        assert {(r.order_id, r.logistic_type, r.freight_share) for r in found.collect()} == {("o1", "drop_off", 4.0), ("o2", "x", None)} and "__key" not in found.columns
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
