"""The model keeps every n-gram, in however many shards."""

import random

from tests.conftest import SMALL
from tests.llm.test_operators import brute_kneser_ney
from tideline.llm import kneser_ney, quality_classifier, quality_rules


def test_every_value_by_definition_in_any_number_of_shards(spark):
    english = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en'").cache()
    texts = {r.doc_id: r.text for r in english.collect()}
    score = brute_kneser_ney(texts.values())
    for rows in (kneser_ney.SHARD_ROWS, 3000):
        model = kneser_ney.train(english, shard_rows=rows)
        assert (len(model.shards) > 1) == (rows == 3000)
        found = quality_rules.measure(english, model, model, "doc_id", "lang", "text").collect()
        assert len(found) == len(texts) and all(abs(r.log_perplexity - score(texts[r.id])) < 1e-5 for r in found)


def test_order_of_words_counts(spark):
    english = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en' and n_chars > 400").select("doc_id", "text").limit(60).collect()
    r, rows = random.Random(3), []
    for d in english:
        words = d.text.split()
        rows += [(d.doc_id, "en", d.text), (-d.doc_id - 1, "en", " ".join(r.sample(words, len(words))))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = kneser_ney.train(docs.where("doc_id >= 0"), running=True)
    found = {x.id: x for x in quality_rules.measure(docs, model, model, "doc_id", "lang", "text").collect()}
    worse = [found[-i - 1].running_perplexity > found[i].running_perplexity for i in found if i >= 0]
    assert sum(worse) > 0.9 * len(worse)
    labels = docs.where("doc_id >= 0").selectExpr("doc_id", "1 as quality")
    scored = {x.doc_id: x.log_perplexity for x in quality_classifier.classify(docs, labels).collect()}
    assert sum(scored[-i - 1] > scored[i] for i in scored if i >= 0) > 0.9 * len(worse)
