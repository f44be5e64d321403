"""Titles, cost rules, listings and stock."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.functions.columns import fixed2
from tideline.operators import catalog, costs, stock
from tideline.sources.schemas import LISTING


def listing(id, sku=None, inv=None, qty=0.0, full=False, premium=False, ordinal=0, status="active", price=10.0, title="t", tags=()):
    kind = "gold_pro" if premium else "gold_special"
    return (id, title, status, price, None, qty, 1.0, kind, False, inv, None, None, None, sku, None, list(tags), {"logistic_type": "fulfillment" if full else None}, [], ordinal)


def listings(spark, *rows):
    return spark.createDataFrame(list(rows), LISTING)


@pytest.mark.parametrize(("title", "n"), [("Kit Com 6 Un", 6), ("Caixa com 12 garrafas", 12), ("Combo 3 unidades", 3), ("Bag in box 5 Litros", 1), ("Kit com 1 un", 1), ("Kit com 99 un", 1), (None, 1)])
def test_bottles(spark, title, n):
    assert spark.createDataFrame([(title,)], "t string").select(text.bottles("t")).first()[0] == n


@pytest.mark.parametrize(
    ("title", "expected"),
    [("Vinho Rosé - Full", "vinho rosé"), ("Vinho Full Bom", "vinho bom"), ("Box 5 Lts", "box 5 litros"), ("Box 5L tinto", "box 5 litros tinto"), ("Vinho Kit com 6 un", "vinho"), ("Éfull x", "é x"), (None, "")],
)
def test_normal_titles(spark, title, expected):
    assert spark.createDataFrame([(title,)], "t string").select(text.normal_title("t")).first()[0] == expected


def test_rules_by_sku_then_title(spark):
    rules = [costs.CostRule(2, "sku", 5.0, match=("zzz",), sku=("K1",)), costs.CostRule(1, "rose", 7.0, match=("Rosé",), tipo=("seco", "doce"), exclui=("promoção",)), costs.CostRule(3, "any", 9.0, match=("vinho",))]
    rows = [("vinho ROSÉ seco", None, "rose"), ("vinho rosé", None, "any"), ("vinho rosé seco promoção", None, "rose"), ("", " K1 ", "sku"), ("", None, None), ("cerveja", "K2", None)]
    df = spark.createDataFrame(rows, "title string, seller_sku string, want string")
    for r in df.withColumn("got", costs.rule_of("title", "seller_sku", rules)["rule_id"]).collect():
        assert r.got == r.want, r


def test_unit_cost_scales_with_bottles_but_not_packaging(spark):
    row = spark.range(1).select(costs.unit_cost(F.lit(13.78), F.lit("x"), F.lit(6), costs.Logistics(1.49, 3.0)).alias("own"), costs.unit_cost(F.lit(13.78), F.lit("Fulfillment"), F.lit(6), costs.Logistics(1.49, 3.0)).alias("full"), costs.unit_cost(F.lit(None).cast("double"), F.lit("x"), F.lit(6)).alias("none")).first()
    assert (round(row.own, 2), round(row.full, 2), row.none) == (94.62, 91.62, None)


def test_two_places_by_binary_value(spark):
    rows = spark.createDataFrame([(x,) for x in (0.125, 0.375, 1.005, 2.675, 1234567.891, 0.0)], "x double").select(fixed2(F.col("x"))).collect()
    assert [r[0] for r in rows] == [0.13, 0.38, 1.0, 2.67, 1234567.89, 0.0]


def one(df):
    return df.first()


def test_stock_of_shared_keys(spark):
    both = [listing("A", "S", "k", 4.0, True, False, 0), listing("B", "S", "k", 9.0, True, True, 1)]
    for mode, classic, premium in ((stock.SAFE, 0.0, 9.0), (stock.LEGACY, 9.0, 0.0)):
        row = one(stock.consolidate(stock.stock_lines(listings(spark, *both), mode), mode))
        assert (row.full, row.full_classic, row.full_premium) == (9.0, classic, premium)


@pytest.mark.parametrize(
    ("rows", "own", "full"),
    [
        ([("A", "S", "k1", 5.0, True), ("B", "S", "k2", 7.0, True)], 0, 12),
        ([("A", "S", None, 6.0, True), ("B", "S", None, 9.0, True)], 0, 9),
        ([("A", "S", "x", 12.0, False), ("B", "S", "y", 5.0, False)], 17, 0),
        ([("A", "S", "x", 10.0, False), ("B", "S", None, 99.0, False)], 10, 0),
        ([("A", "S", None, 3.0, False), ("B", "S", None, 8.0, False)], 8, 0),
    ],
)
def test_stock_rules(spark, rows, own, full):
    lines = stock.stock_lines(listings(spark, *[listing(*r) for r in rows]))
    row = one(stock.consolidate(lines))
    assert (row.own, row.full) == (own, full)
    assert stock.alerts(lines).count() == (1 if row.own_without_id_ignored else 0)
    counted = stock.audit(lines).where("considered").agg(F.sum("quantity")).first()[0]
    assert counted == own + full


def test_negative_stock(spark):
    rows = listings(spark, listing("A", "S", "k", -5.0, True), listing("B", "S", "k", -2.0, True))
    assert one(stock.consolidate(stock.stock_lines(rows, stock.LEGACY), stock.LEGACY)).full == -2
    assert one(stock.consolidate(stock.stock_lines(rows))).full == 0


def test_audit_reasons(spark):
    lines = stock.stock_lines(listings(spark, listing("A", "S", "k", 4.0, True, False), listing("B", "S", "k", 9.0, True, True), listing("C", "S", "k", 9.0, True, False)))
    found = {r.item_id: r.reason for r in stock.audit(lines).collect()}
    assert found == {
        "A": "Deduplicado na chave inv:k: perdeu para B por saldo maior (9 > 4).",
        "B": "Vencedor determinístico da chave inv:k.",
        "C": "Deduplicado na chave inv:k: perdeu para B por empate de saldo resolvido por premium.",
    }


@pytest.mark.parametrize(("qty", "name"), [(29, "ruptura"), (30, "alerta"), (89, "alerta"), (90, "ok"), (365, "ok"), (366, "excesso")])
def test_classes(spark, qty, name):
    df = spark.createDataFrame([(float(qty), 30.0)], "s double, v double")
    assert one(stock.classified(df, "s", "v", 30))["class"] == name


def test_velocity_and_refusals(spark):
    row = one(stock.classified(spark.createDataFrame([(100.0, 10.0)], "s double, v double"), "s", "v", 30))
    assert (row.velocity, row.days_of_stock) == (0.33, 303)
    row = one(stock.classified(spark.createDataFrame([(100.0, 0.0)], "s double, v double"), "s", "v", 30))
    assert (row["class"], row.days_of_stock) == ("semvenda", None)
    with pytest.raises(Exception, match="negative"):
        stock.classified(spark.createDataFrame([(-1.0, 0.0)], "s double, v double"), "s", "v", 30).collect()
    with pytest.raises(ValueError):
        stock.classified(spark.createDataFrame([(1.0, 0.0)], "s double, v double"), "s", "v", 0)


def test_full_marks(spark):
    row = [listing("A", tags=[" Fulfillment "])]
    assert stock.stock_lines(listings(spark, *row)).first().full and not stock.stock_lines(listings(spark, *row), stock.LEGACY).first().full


def test_slim_listings_and_counts(spark):
    rows = listings(spark, listing("A", qty=float("nan")), listing("", qty=1.0), listing("B", status="paused", tags=["x", None]))
    out = {r.id: r for r in catalog.slim_listings(rows).collect()}
    assert set(out) == {"A", "B"} and out["A"].available_quantity is None and out["B"].tags == ["x"]
    assert tuple(catalog.catalog_counts(rows).first()) == (3, 2, 1, 0)
