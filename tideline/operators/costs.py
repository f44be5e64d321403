"""Unit costs: which rule a line falls under, and what a sold unit costs.

Rules are configuration: a list of at most MAX_RULES, checked when loaded, becomes one column
expression, so finding a line's rule needs no join and no shuffle. A table of rules may be of
any size: its terms are found in titles through an index of their letters (with_rule_table).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import blank_to_null, col, is_fulfilment
from tideline.functions.text import bottles, fold, fold_text

MAX_RULES = 1000


@dataclass(frozen=True)
class CostRule:
    ordem: int
    id: str
    custo_produto: float
    match: tuple[str, ...]
    sku: tuple[str, ...] = ()
    tipo: tuple[str, ...] = ()
    exclui: tuple[str, ...] = ()


@dataclass(frozen=True)
class Logistics:
    freight: float = 0.0
    packaging: float = 3.0


@dataclass(frozen=True)
class Fees:
    marketplace: float = 0.148
    shipping: float = 0.144


def checked_rules(rules) -> list[CostRule]:
    """Sorted by priority; duplicates of a priority, bad costs and rules without terms are refused."""
    rules = sorted(rules, key=lambda r: r.ordem)
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} cost rules")
    if len({r.ordem for r in rules}) < len(rules):
        raise ValueError("two cost rules have the same priority")
    for r in rules:
        if not r.match or not r.custo_produto >= 0:
            raise ValueError(f"cost rule {r.id} has no terms or a bad cost")
    return rules


def load_rules(text: str) -> list[CostRule]:
    """Rules of a JSON list with the fields of CostRule."""
    lists = ("match", "sku", "tipo", "exclui")
    return checked_rules(CostRule(**{k: tuple(v or ()) if k in lists else v for k, v in row.items()}) for row in json.loads(text))


def _found(rule: CostRule, via: str) -> Column:
    return F.struct(F.lit(rule.id).alias("rule_id"), F.lit(float(rule.custo_produto)).alias("product_cost"), F.lit(via).alias("via"))


def rule_of(title: str | Column, seller_sku: str | Column, rules, folded: str | Column | None = None) -> Column:
    """struct(rule_id, product_cost, via) of the line's rule; null where no rule fits.

    An exact SKU comes first. Else the first rule by priority of whose terms one stands in
    the folded title, of whose kinds one does too (if it has any), and of whose exclusions
    none does. Only terms are folded; kinds and exclusions are compared as they are written.
    """
    rules = checked_rules(rules)
    by_sku: dict[str, CostRule] = {}
    for r in rules:
        for s in r.sku:
            by_sku.setdefault(s, r)
    t = fold(title) if folded is None else col(folded)
    anyone = lambda terms: F.greatest(*[t.contains(x) for x in terms], F.lit(False))
    chain = F.lit(None).cast("struct<rule_id:string,product_cost:double,via:string>")
    for r in reversed(rules):
        hit = anyone([fold_text(m) for m in r.match])
        if r.tipo:
            hit = hit & anyone(r.tipo)
        if r.exclui:
            hit = hit & ~anyone(r.exclui)
        chain = F.when(hit, _found(r, "title")).otherwise(chain)
    chain = F.when(t != "", chain)
    if by_sku:
        table = F.create_map(*[x for s, r in by_sku.items() for x in (F.lit(s), _found(r, "sku"))])
        chain = F.coalesce(F.try_element_at(table, F.coalesce(blank_to_null(seller_sku), F.lit(""))), chain)
    return chain


def unit_cost(product_cost: str | Column, logistic_type: str | Column, n_bottles: Column, logistics: Logistics = Logistics()) -> Column:
    """Cost of one sold unit: product and freight by bottle, packaging once unless fulfilled; null if unknown."""
    n = F.greatest(F.lit(1), F.coalesce(F.floor(n_bottles), F.lit(1)))
    return (col(product_cost) + F.lit(logistics.freight)) * n + F.when(is_fulfilment(logistic_type), 0.0).otherwise(logistics.packaging)


def with_rules(items: DataFrame, rules) -> DataFrame:
    """Adds rule_id, product_cost, via and bottles to rows with title and seller_sku: lines, or the items that lines share."""
    held = items.withColumn("__rule", rule_of("title", "seller_sku", rules))
    held = held.withColumns({"rule_id": F.col("__rule.rule_id"), "product_cost": F.col("__rule.product_cost"), "via": F.col("__rule.via")})
    return held.withColumn("bottles", F.when(F.col("rule_id").isNotNull(), bottles("title")).otherwise(F.lit(1))).drop("__rule")


#: Letters of an entry of the index of terms.
INDEX_LETTERS = 3


def letters_of(text: Column) -> Column:
    """The distinct runs of up to INDEX_LETTERS letters of a text; '' too, which stands in every text."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[runs(n) for n in range(1, INDEX_LETTERS + 1)]))


def title_hits(titles: DataFrame, terms: DataFrame) -> DataFrame:
    """title, term: every distinct title and the terms that stand in it. titles: title; terms: term.

    A title with a term has all the term's runs of letters. The term is looked up by the one that
    fewest titles have, so rarely by one that stands in most of them; what it finds is verified.
    """
    index = titles.select("title", F.explode(letters_of(F.col("title"))).alias("letters"))
    often = index.groupBy("letters").agg(F.count(F.lit(1)).alias("often"))
    size = F.least(F.length("term"), F.lit(INDEX_LETTERS))
    keys = terms.select("term", F.explode(F.filter(letters_of(F.col("term")), lambda x: F.length(x) == size)).alias("letters"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.coalesce("often", F.lit(0)), "letters"))
    keys = keys.join(often, "letters", "left").withColumn("rank", rank).where("rank = 1 and often is not null").select("term", "letters")
    return index.join(keys, "letters").where(F.col("title").contains(F.col("term"))).select("title", "term")


def with_rule_table(items: DataFrame, rules: DataFrame) -> DataFrame:
    """with_rules for a table of rules (ordem, id, custo_produto, sku, match, tipo, exclui) of any size; same answers.

    Joins by SKU, by letters and by title take the place of one expression; every step is an
    equi-join. Of rules with the same term, kinds and exclusions only the first can count, so a
    term that many rules share gives few rows. ordem tells rules apart.
    """
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("sku", "match", "tipo", "exclui")}
    rules = rules.select("ordem", F.struct(F.col("id").alias("rule_id"), F.col("custo_produto").cast("double").alias("product_cost")).alias("rule"), *[v.alias(c) for c, v in lists.items()])
    by_sku = rules.select("ordem", "rule", F.explode("sku").alias("__sku")).groupBy("__sku").agg(F.min_by("rule", "ordem").alias("__by_sku"))

    own = items.withColumns({"__title": fold("title"), "__sku": F.coalesce(blank_to_null("seller_sku"), F.lit(""))})
    titles = own.where("__title <> ''").select(F.col("__title").alias("title")).distinct()
    terms = rules.select("ordem", "rule", "tipo", "exclui", F.explode("match").alias("term")).withColumn("term", fold("term"))
    terms = terms.groupBy("term", "tipo", "exclui").agg(F.min("ordem").alias("ordem"), F.min_by("rule", "ordem").alias("rule"))
    inside = lambda xs: F.exists(xs, lambda x: F.col("title").contains(x))
    hits = title_hits(titles, terms.select("term").distinct()).join(terms, "term")
    hits = hits.where(((F.size("tipo") == 0) | inside("tipo")) & ~inside("exclui"))
    by_title = hits.groupBy(F.col("title").alias("__title")).agg(F.min_by("rule", "ordem").alias("__by_title"))

    held = own.join(by_sku, "__sku", "left").join(by_title, "__title", "left")
    found = F.coalesce("__by_sku", "__by_title")
    via = F.when(F.col("__by_sku").isNotNull(), "sku").when(F.col("__by_title").isNotNull(), "title")
    held = held.withColumns({"rule_id": found["rule_id"], "product_cost": found["product_cost"], "via": via})
    held = held.withColumn("bottles", F.when(F.col("rule_id").isNotNull(), bottles("title")).otherwise(F.lit(1)))
    return held.select(*items.columns, "rule_id", "product_cost", "via", "bottles")


def with_costs(lines: DataFrame, rules, logistics: Logistics = Logistics()) -> DataFrame:
    """Adds rule_id, product_cost, via, bottles and unit_cost to lines with title, seller_sku and logistic_type.

    Lines whose items have had their rules found already keep them.
    """
    held = lines if "product_cost" in lines.columns else with_rules(lines, rules)
    return held.withColumn("unit_cost", unit_cost("product_cost", "logistic_type", F.col("bottles"), logistics))
