"""Sales, margin and ranking on hand-made orders, nulls and zeros included."""

from datetime import date

import pytest

from tideline.operators import lines, margin, ranking, sales, shipping
from tideline.operators.costs import CostRule, checked_rules, load_rules
from tideline.operators.orders import change_counts, merge_orders, slim_orders
from tideline.sources.schemas import ORDER, RAW_ORDER, SHIPMENT, SKU_MAP

PERIOD = (date(2026, 8, 1), date(2026, 8, 31))
RULES = [CostRule(1, "a", 12.80, match=("alpha",)), CostRule(2, "b", 13.78, match=("beta",))]


def order(id, status="paid", items=(), paid=0.0, total=0.0, when="2026-08-10T12:00:00.000-03:00", ship=None, kind=None, ordinal=None):
    made = [{"quantity": q, "unit_price": p, "item": {"id": i, "title": t, "seller_sku": s, "variation_id": None}} for i, t, s, q, p in items]
    shipping_ = None if ship is None and kind is None else {"id": ship, "logistic_type": kind}
    return (id, status, when, paid, total, made, {"nickname": "n"}, shipping_, ordinal if ordinal is not None else int(id) if id.isdigit() else None)


def orders(spark, *rows):
    return spark.createDataFrame(list(rows), ORDER)


def ships(spark, *rows):
    return spark.createDataFrame(list(rows), SHIPMENT)


def test_only_listed_statuses_are_sales(spark):
    statuses = [("paid", 100.0), ("partially_refunded", 666.0), ("cancelled", 5.0), ("in_process", 5.0), (None, 5.0), ("x", 5.0)]
    df = orders(spark, *[order(str(i), s, paid=p) for i, (s, p) in enumerate(statuses)])
    row = sales.sales_summary(df, *PERIOD).first()
    assert (row.orders, row.revenue, row.units) == (2, 766.0, 0.0)


def test_gross_falls_back_to_total_and_fees(spark):
    row = sales.gross_and_net(orders(spark, order("1", paid=0.0, total=80.0)), *PERIOD).first()
    assert row.gross == 80
    row = sales.gross_and_net(orders(spark, order("1", paid=1000.0)), *PERIOD).first()
    assert [round(x, 6) for x in (row.marketplace_fee, row.shipping_fee, row.net)] == [-148, -144, 708]


def test_period_edges_and_zero_quantity(spark):
    whens = ["2026-08-01T00:00:00.000-03:00", "2026-08-31T23:59:59.999-03:00", "2026-07-31T23:59:59.999-03:00", "2026-09-01T00:00:00.000-03:00", None, "bad"]
    df = orders(spark, *[order(str(i), items=[("I", "t", None, 0.0, 1.0)], paid=10.0, when=w) for i, w in enumerate(whens)])
    row = sales.sales_summary(df, *PERIOD).first()
    assert (row.revenue, row.units) == (20.0, 0.0)
    assert {r.item_id: r.units for r in sales.units_by_item(df).collect()} == {"I": 6.0}


def test_first_item_and_all_items(spark):
    df = orders(spark, order("1", items=[("I1", "t", None, 1.0, 100.0), ("I2", "u", None, 4.0, 50.0)], paid=300.0), order("2", paid=9.0))
    assert [tuple(r) for r in sales.sales_by_first_item(df).collect()] == [("I1", 1, 1.0, 300.0)]
    skus = spark.createDataFrame([("I1", "A"), ("I2", "B")], SKU_MAP)
    assert {(r.sku, r.units, r.revenue) for r in sales.sales_by_sku(df, skus).collect()} == {("A", 1.0, 100.0), ("B", 4.0, 200.0)}
    assert sales.sku_detail(df, skus, "B").first().amount == 200.0


def test_text_month_and_civil_day(spark):
    df = orders(spark, order("1", paid=40.0, when="2026-07-11T02:00:00Z"))
    assert [tuple(r) for r in sales.revenue_by_day(df, 2026, 7).collect()] == [(10, 40.0)]
    assert [tuple(r) for r in sales.revenue_by_text_month(df).collect()] == [("2026-07", 40.0)]


def test_cancel_reasons_take_the_first_text(spark):
    rows = [order("1", "cancelled", total=100.0) + ({"group": "seller", "code": "out", "description": "one"},), order("2", "cancelled", total=50.0) + ({"group": "seller", "code": "out", "description": "two"},), order("3", None, total=30.0) + (None,)]
    found = sales.cancel_reasons(spark.createDataFrame(rows, RAW_ORDER)).collect()
    assert [tuple(r) for r in found] == [("seller", "out", 2, 150.0, "one"), ("desconhecido", "sem_detalhe", 1, 30.0, "Sem descricao")]


def test_margin_of_own_and_fulfilled_sales(spark):
    for kind, cost, left, pct in ((None, 31.60, 25.04, 31.3), ("Fulfillment", 25.60, 31.04, 38.8)):
        df = orders(spark, order("1", items=[("I", "Alpha", None, 2.0, 40.0)], kind=kind))
        row = margin.margin_total(margin.priced_lines(df, ships(spark), RULES, *PERIOD)).first()
        assert (round(row.cost, 2), round(row.margin, 2), round(row.margin_pct, 1)) == (cost, left, pct)


@pytest.mark.parametrize(("known", "unknown", "available"), [(70.0, 30.0, False), (80.0, 20.0, True)])
def test_a_fifth_without_cost_is_still_available(spark, known, unknown, available):
    df = orders(spark, order("1", items=[("I", "alpha", None, 1.0, known), ("J", "other", None, 1.0, unknown)]))
    row = margin.margin_total(margin.priced_lines(df, ships(spark), RULES, *PERIOD)).first()
    assert row.available is available and (row.margin is not None) is available and row.revenue_without_cost == unknown


@pytest.mark.parametrize(
    ("items", "cost", "expected"),
    [
        ([(1.0, 80.0), (1.0, 20.0)], 30.0, [24, 6]),
        ([(3.0, 0.0), (1.0, 0.0)], 8.0, [6, 2]),
        ([(1.0, -5.0), (1.0, 50.0)], 10.0, [0, 10]),
        ([(1.0, 5.0)], None, [None]),
        ([(1.0, 5.0)], 0.0, [0]),
    ],
)
def test_freight_shares(spark, items, cost, expected):
    df = orders(spark, order("1", items=[(f"I{i}", "alpha", None, q, p) for i, (q, p) in enumerate(items)], ship="S"))
    found = lines.sale_lines(df, ships(spark, ("S", "drop_off", cost))).orderBy("pos").collect()
    assert [r.freight_share for r in found] == expected


def test_freight_base_reaches_over_the_period(spark):
    a = order("1", items=[("I", "alpha", None, 1.0, 60.0)], ship="S")
    b = order("2", items=[("I", "alpha", None, 1.0, 40.0)], ship="S", when="2026-09-02T12:00:00.000-03:00")
    row = margin.priced_lines(orders(spark, a, b), ships(spark, ("S", None, 20.0)), RULES, *PERIOD).collect()
    assert [r.freight_share for r in row] == [12.0]


def test_partial_costs_in_a_ranking(spark):
    df = orders(spark, order("1", items=[("I", "alpha", "X", 1.0, 40.0), ("J", "other", "X", 1.0, 60.0), ("K", "none", "Y", 1.0, 500.0)]))
    rows = ranking.ranking_rows(margin.priced_lines(df, ships(spark), RULES, *PERIOD))
    x = rows.where("sku = 'X'").first()
    assert (x.cost_coverage, x.revenue, x.costed_revenue, x.label) == ("parcial", 100.0, 40.0, "other")
    y = rows.where("sku = 'Y'").first()
    assert y.cost_coverage == "ausente" and y.margin is None
    assert [ranking.ranking_limit(n) for n in (None, 0, 3.9, 99, float("nan"))] == [5, 1, 3, 20, 5]


def test_results_do_not_depend_on_order_or_partitions(spark):
    made = [order(str(i), items=[("I", "alpha", f"S{i % 3}", 1.0 + i % 2, 33.33), ("J", "beta x", None, 7.0, 2.1)], ship=str(i // 2)) for i in range(40)]
    held = [(str(i), "drop_off", 27.41 if i % 3 else None) for i in range(20)]
    results = []
    for rows, n in ((made, 1), (made[::-1], 7)):
        df = orders(spark, *rows).repartition(n)
        results.append(margin.margin_by_sku(margin.priced_lines(df, ships(spark, *held), RULES, *PERIOD)).collect())
    assert results[0] == results[1]
    lines_ = margin.priced_lines(orders(spark, *made), ships(spark, *held), RULES, *PERIOD)
    assert round(sum(r.margin for r in results[0]), 6) == round(margin.margin_total(lines_).first().margin, 6)
    shares = {r.shipment_id: r.s for r in lines_.groupBy("shipment_id").agg({"freight_share": "sum"}).withColumnRenamed("sum(freight_share)", "s").collect()}
    assert all(abs(v - 27.41) < 1e-9 for v in shares.values() if v is not None)


def test_pending_and_coverage(spark):
    df = orders(spark, order("1", ship="A"), order("2", ship="B"), order("3", ship=" "), order("4", "cancelled", ship="C"))
    known = ships(spark, ("A", "x", 0.0), ("B", "x", -1.0))
    assert [r.shipment_id for r in shipping.pending_shipments(df, known).collect()] == ["B"]
    row = shipping.freight_coverage(df, known).first()
    assert (row.shipments, row.resolved, row.pending, row.fraction) == (2, 1, 1, 0.5)
    assert shipping.freight_coverage(orders(spark), known).first().fraction == 1.0
    merged = shipping.merge_shipments(known, ships(spark, ("B", "y", 7.0), ("", "y", 1.0), ("D", "", 1.0)))
    assert {tuple(r) for r in merged.collect()} == {("A", "x", 0.0), ("B", "y", 7.0)}


def test_merge_and_first_seen(spark):
    base = orders(spark, order("10", paid=1.0), order("11", paid=1.0))
    new = orders(spark, order("12", paid=1.0), order("10", "cancelled", paid=1.0), order("11", paid=1.0))
    row = change_counts(base, new).first()
    assert (row["new"], row.changed, row.same) == (1, 1, 1)
    assert {(r.id, r.status) for r in merge_orders(base, new).collect()} == {("10", "cancelled"), ("11", "paid"), ("12", "paid")}
    twice = orders(spark, order("1", paid=1.0, ordinal=0), order("1", paid=2.0, ordinal=1))
    assert lines.first_seen(twice).first().paid_amount == 1.0


def test_slim_orders_keep_missing_structs_missing(spark):
    row = slim_orders(spark.createDataFrame([("1", "paid", None, None, None, None, None, None, None, None)], RAW_ORDER)).first()
    assert row.buyer is None and row.shipping is None and row.order_items == []


def test_rules_are_checked():
    with pytest.raises(ValueError):
        checked_rules([CostRule(1, "a", 1.0, match=("x",)), CostRule(1, "b", 1.0, match=("y",))])
    with pytest.raises(ValueError):
        checked_rules([CostRule(1, "a", -1.0, match=("x",))])
    assert load_rules('[{"ordem": 2, "id": "b", "custo_produto": 1, "match": ["x"], "sku": null}, {"ordem": 1, "id": "a", "custo_produto": 2, "match": ["y"]}]')[0].id == "a"
