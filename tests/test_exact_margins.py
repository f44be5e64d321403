"""Margins that end in half a cent, and equal revenues in a full ranking."""

from pyspark.sql import functions as F

from tideline.operators import margin, ranking

SCHEMA = "sku string, title string, item_id string, order_id string, pos int, ordinal long, revenue double, quantity double, unit_cost double, marketplace_fee double, shipping_fee double, cost double, real boolean, first_of_order boolean"


def priced(spark, *rows):
    made = [(sku, "T", f"I{i}", str(i), 0, i, revenue, 1.0, 1.0, fee, ship, cost, False, True) for i, (sku, revenue, fee, ship, cost) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def test_half_cents_stay_half_cents(spark):
    lines = priced(spark, ("A", 54998.75, 8139.815, 7919.82, 13634.5), ("B", 60856.25, 9006.725, 0.0, 10686.5))
    for rows in (ranking.ranking_rows(lines), margin.margin_by_sku(lines)):
        assert {x.sku: (x.margin, x.shown) for x in rows.withColumn("shown", F.round("margin", 2)).collect()} == {"A": (25304.615, 25304.62), "B": (41163.025, 41163.03)}


def test_equal_revenues_rank_by_sku(spark):
    # Added up as doubles, the revenues differ by the order of their lines.
    parts = (0.1, 0.2, 0.3, 1e6)
    rows = [(sku, v, 0.0, 0.0, 0.0) for sku, order in (("B", (0, 1, 2, 3)), ("A", (3, 2, 1, 0)), ("C", (3, 0, 2, 1))) for v in (parts[i] for i in order)]
    found = ranking.ranking(priced(spark, *rows).coalesce(1), everything=True).orderBy("position").collect()
    assert [(x.position, x.sku, x.revenue) for x in found] == [(1, "A", 1000000.6), (2, "B", 1000000.6), (3, "C", 1000000.6)]


def test_a_ranking_document_reads_lines_once(spark):
    """Orders and lines are scanned for the document's rows alone; totals and freight come from these."""
    from tests.conftest import SMALL
    from tideline.operators import lines
    from tideline.plans import catalogue
    from tideline.plans import documents as docs
    from tideline.plans.service import Query

    made, count = lines.shipment_totals, []
    lines.shipment_totals = lambda rows: count.append(1) or made(rows)
    try:
        q = Query("sales_ranking", "margin", docs.Period(*catalogue.NOW), rank_by="margin", limit=5)
        found = docs.document(q, catalogue.snapshot(spark, SMALL))
    finally:
        lines.shipment_totals = made
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(count) == 1 and "l_orderkey" not in plan
    row = found.first()
    costed = catalogue.priced(spark, SMALL).where("unit_cost is not null")
    sums = costed.agg(*[F.sum(F.when(c, F.col(v)).cast("decimal(28,8)")).cast("double") for c, v in ((F.col("real"), "shipping_fee"), (~F.col("real"), "shipping_fee"))]).first()
    assert (row.shippingCost.actual or 0, row.shippingCost.estimatedByPercent or 0) == tuple(x or 0 for x in sums)


def test_lines_are_cut_before_they_are_marked(spark):
    from tests.conftest import SMALL
    from tideline.operators.lines import sale_lines
    from tideline.plans import catalogue
    from tideline.functions.dates import in_period
    from tideline.sources import star_schema as star

    rows, ships, period = star.order_lines(spark, SMALL, star.RULES), star.shipments(spark, SMALL), in_period("civil_date", *catalogue.NOW)
    columns = ("order_id", "pos", "sku", "freight_share", "revenue", "first_of_order", "logistic_type")
    late, soon = (sorted(map(tuple, x.select(*columns).collect())) for x in (sale_lines(rows, ships).where(period), sale_lines(rows, ships, period)))
    assert late == soon and late
