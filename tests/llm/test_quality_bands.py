"""Bands and limits of perplexity follow the distribution; rows are judged each by itself."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tideline.llm import kneser_ney, quality_classifier, quality_rules
from tideline.llm.common import Scratch


def quantile(values, q):
    values = sorted(values)
    return values[max(0, math.ceil(q * len(values) - 1e-9) - 1)]


def test_bands_are_quantiles_of_what_passes_the_base_rules(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = quality_rules.judge(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    room = {r.doc_id: kneser_ney.SPREAD / math.sqrt(r.word_chars + r.n_words) for r in rows if r.n_words}
    good = [r for r in rows if not r.base_failed]
    for value, name in (("log_perplexity", "band"), ("running_perplexity", "running")):
        for lang in {r.lang for r in good}:
            own = [r for r in good if r.lang == lang]
            low, high = quantile([r[value] + room[r.doc_id] for r in own], quality_rules.LOW), quantile([r[value] - room[r.doc_id] for r in own], quality_rules.HIGH)
            assert all(abs(r[f"{name}_high"] - high - room[r.doc_id]) <= 0.0011 and abs(r[f"{name}_low"] - low + room[r.doc_id]) <= 0.0021 for r in own)
    inside = lambda r: r.band_low <= r.log_perplexity <= r.band_high and r.running_low <= r.running_perplexity <= r.running_high
    assert all(r.kept == (not r.base_failed and inside(r)) for r in rows if r.n_words) and any(not r.kept for r in good)


def test_the_reference_is_the_likelier_part_once(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    twice = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 10_000))
    model = kneser_ney.train(twice)
    found = quality_rules.reference(twice, model, Scratch(spark, "test"), "doc_id", "lang", "text").collect()
    scored = kneser_ney.perplexities(documents, model, "doc_id", "lang", "text").where("n_symbols > 0").collect()
    by_lang = defaultdict(dict)
    for r in scored:
        by_lang[r.lang][r.id] = r.log_perplexity - kneser_ney.SPREAD / math.sqrt(r.n_symbols)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert max(Counter((r.lang, r.text) for r in found).values()) == 1
    for lang, values in by_lang.items():
        limit = math.ceil(quantile(values.values(), quality_rules.REFERENCE) * 1000) / 1000
        assert {r.text for r in found if r.lang == lang} == {texts[i] for i, v in values.items() if v <= limit}


def test_marked_words_leave_the_band(spark):
    r = random.Random(7)
    vocabulary = ["".join(r.choice("aeinrst") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(40)) for _ in range(200)]
    junk = [" ".join(r.choice(vocabulary)[:3] + r.choice("#*$%&") * 2 for _ in range(40)) for _ in range(6)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts + junk)], "doc_id long, lang string, text string")
    kept = {x.doc_id: x.kept for x in quality_rules.judge(docs).collect()}
    assert not any(kept[200 + i] for i in range(6)) and sum(kept[i] for i in range(200)) >= 176  # each of two bands leaves out few


def test_rows_that_share_an_id_are_kept_by_their_own_text(spark):
    r = random.Random(5)
    good = [" ".join("".join(r.choice("aeinrst") for _ in range(3)) for _ in range(60)) for _ in range(300)]
    rows = [(i, "en", t) for i, t in enumerate(good)] + [(None, "en", t) for t in good[:40]] + [(7, "en", "too short"), (None, "en", "too short"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    kept = Counter((x.doc_id, x.text) for x in quality_rules.keep_good(docs).collect())
    assert kept[7, "too short"] == kept[None, "too short"] == kept[None, None] == 0
    assert kept[7, good[7]] == 1 and sum(kept[None, t] for t in good[:40]) > 20


def test_limits_are_quantiles_of_held_out_trusted_documents(spark):
    documents, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.classify(documents, labels).withColumn("held", quality_classifier.held_out("doc_id")).collect()
    trusted = {r.doc_id for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").collect()}
    room = lambda r: kneser_ney.SPREAD / math.sqrt(r.n_symbols)
    for lang in {r.lang for r in rows}:
        own = [r for r in rows if r.lang == lang and r.n_symbols]
        known = [r for r in own if r.doc_id in trusted]
        unseen = [r for r in known if r.held] or known
        limit = quantile([r.log_perplexity - room(r) for r in unseen], quality_classifier.QUANTILE) + quality_classifier.MARGIN
        assert all(abs(r.limit - limit - room(r)) <= 0.0011 and r.kept == (r.log_perplexity <= r.limit) for r in own)
    bad = [r.kept for r in rows if r.doc_id in {x.doc_id for x in labels.where("quality = 0").collect()}]
    assert sum(bad) < 0.3 * len(bad)
