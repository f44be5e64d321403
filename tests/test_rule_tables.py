"""Rules as a table: the same answers as the column expression, without a nested-loop join."""

import random
import time

from pyspark.sql import functions as F

from tideline.operators import costs
from tideline.sources.schemas import COST_RULE


def table(spark, rules):
    return spark.createDataFrame([(r.ordem, r.id, float(r.custo_produto), list(r.sku), list(r.match), list(r.tipo), list(r.exclui)) for r in rules], COST_RULE)


def made(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(["Vinho", "rosé", "BAG", "in", "box", "5l", "tinto", "é", "x", "kit 6", "", "seco", "doce"])
    titles = [" ".join(word() for _ in range(r.randrange(5))) for _ in range(200)] + [None, "", " "]
    some = lambda k: tuple(word() for _ in range(r.randrange(k)))
    rules = [costs.CostRule(i, f"r{i}", 1.0 + i, (word() + word(), *some(3)), tuple(f"S{r.randrange(30)}" for _ in range(r.randrange(2))), some(3), tuple(x for x in some(2) if x)) for i in r.sample(range(10 * n), n)]
    items = [(t, r.choice([None, "", f"S{r.randrange(40)}", f" S{r.randrange(40)} "]), i) for i, t in enumerate(titles * 2)]
    return items, rules


def test_a_table_gives_what_the_expression_gives(spark):
    for seed in range(3):
        items, rules = made(seed, 40)
        df = spark.createDataFrame(items, "title string, seller_sku string, rule int")
        want = sorted(map(tuple, costs.with_rules(df, rules).select("rule", "title", "seller_sku", "rule_id", "product_cost", "via", "bottles").collect()))
        found = costs.with_rule_table(df, table(spark, rules))
        assert sorted(map(tuple, found.select("rule", "title", "seller_sku", "rule_id", "product_cost", "via", "bottles").collect())) == want and {w[5] for w in want} == {None, "sku", "title"}
        assert costs.with_rule_table(df, table(spark, rules).limit(0)).where("rule_id is not null").count() == 0


def test_many_rules(spark):
    ids = spark.range(100_000)
    rules = ids.select(
        F.col("id").cast("int").alias("ordem"), F.concat(F.lit("r"), "id").alias("id"), F.lit(1.0).alias("custo_produto"), F.array().cast("array<string>").alias("sku"),
        F.array(F.when(F.col("id") % 3 == 0, "steel").otherwise(F.concat(F.lit("steel "), (F.col("id") * 7919 % 100_000).cast("string"), F.lit("z")))).alias("match"),
        F.when(F.col("id") < 99_000, F.array(F.lit("nowhere"))).otherwise(F.array().cast("array<string>")).alias("tipo"), F.array().cast("array<string>").alias("exclui"),
    )
    parts = spark.range(2000).select(F.concat(F.lit("big steel "), (F.col("id") * 50).cast("string"), F.lit("z box")).alias("title"), F.when(F.col("id") < 0, "S").alias("seller_sku"), "id")
    found = costs.with_rule_table(parts, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    began = time.time()
    rows = found.select("id", "rule_id").collect()
    assert time.time() - began < 300 and len(rows) == 2000
    number = {i * 7919 % 100_000: i for i in range(99_000, 100_000) if i % 3}
    first = min(i for i in range(99_000, 100_000) if i % 3 == 0)
    want = {}
    for i in range(2000):
        title = f"{i * 50}z"
        hits = [n for k, n in number.items() if title == f"{k}z"] + [first]
        want[i] = f"r{min(hits)}"
    assert {r.id: r.rule_id for r in rows} == want
