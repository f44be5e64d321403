"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tideline.llm import exact_dedup, html_extraction, mixing, ngram_jaccard, packing, pii, quality_classifier, quality_rules, queries, token_counts, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, copy string, bucket string, label string, hash string, run int"
LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
ROWS = [
    (1, "a b c", "en", "s", 1),
    (1, "a b c", "en", "s", 1),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (None, "no id here but some words to read", "en", None, 1),
    (None, None, None, None, None),
    (4, LONG, None, "s", 9),
    (5, LONG, None, "s", 9),
    (6, "ümlaut 😀 text +49 30 1234567 a@b.cd", "de", "t", 3),
    (7, " \t\n ", "de", "t", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 5, "c", "b", "l", "h", 3) for r in ROWS], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 0, 1), (None, 1, 1), (4, None, None), (5, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")


PER_ROW = {
    "exact": lambda d, l: exact_dedup.exact_groups(d),
    "rules": lambda d, l: quality_rules.judge(d),
    "classifier": quality_classifier.classify,
    "tokens": lambda d, l: token_counts.count_tokens(d, queries.COUNTING_VOCABULARY),
    "pii": lambda d, l: pii.detect(d),
    "near": lambda d, l: ngram_jaccard.near_duplicates(d),
    "toxicity": toxicity.classify,
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_for_each_row(docs, labels, name):
    rows = PER_ROW[name](docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    if name == "toxicity":
        assert len({r.score for r in rows if r.doc_id in (2, 3, 7)}) == 1


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_tables(docs, labels, name):
    assert PER_ROW[name](docs.limit(0), labels.limit(0)).count() == 0
    assert PER_ROW[name](docs, labels.limit(0)).count() == len(ROWS)


def test_packing_edges(docs):
    rows = packing.pack(docs, queries.PACKING_TOKENIZER).where("start = 0").collect()
    assert len(rows) == len(ROWS) and packing.pack(docs.limit(0), queries.PACKING_TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, queries.PACKING_TOKENIZER, longest=1000)


def test_mixing_edges(docs):
    assert set(mixing.mix(docs).columns) >= {"copy", "shuffle_key", "run"}
    assert mixing.mix(docs, total=5_000).count() > 3_000
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs, {}).count() == 0


def test_rows_without_id_have_numbers_of_their_own(spark):
    one = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"))
    mixed = one.union(one.limit(2000).withColumn("text", F.uuid())).union(spark.range(500).select("id", F.lit("x"), F.lit(None)))
    for seed in range(1, 7):
        out = mixing.mix(one, total=5_000, seed=seed)
        assert abs(out.count() - 5_000) < 250 and out.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    out = mixing.mix(mixed, total=7_500, seed=3)
    assert abs(out.count() - 7_500) < 400 and out.select("shuffle_key").distinct().count() == out.count()
    assert sorted(map(str, mixing.mix(mixed.repartition(3), total=7_500, seed=3).collect())) == sorted(map(str, out.collect()))


def test_pieces_of_copies_are_told_apart_and_shuffled(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of a text "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    mixed = corpus_pipeline.source_mix(spark, docs, SMALL).union(docs.limit(50)).union(docs.limit(50))
    pieces = corpus_pipeline.packing(spark, mixed, SMALL).collect()
    assert len({(p.doc_row, p.start) for p in pieces}) == len(pieces) > len({(p.doc_id, p.start) for p in pieces})
    longest = [p.doc_id for p in pieces if p.length == max(q.length for q in pieces)]
    near = sum(abs(a - b) < 300 for a, b in zip(longest, longest[1:], strict=False)) / len(longest)
    assert near < 0.3  # a fifth of random pairs lie so close
    order = [(p.doc_row, p.start) for p in pieces]
    assert sum(a[0] == b[0] for a, b in zip(order, order[1:], strict=False)) < 0.05 * len(order)


def test_dedup_keeps_one_of_repeated_rows(docs):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1
    rows = exact_dedup.exact_groups(docs).where("kept")
    # Texts: a b c; empty (nulls too); no id; LONG; umlaut; one space.
    assert rows.count() == 6 and kept.count() == 6


def test_pages_edges(spark):
    schema = "page_id long, url string, html string, text string, page long, open int"
    rows = [(None, None, None, "x", 1, 2), (1, "http://a/b", "", "x", 1, 2), (1, "http://a/b", "<p>x y</p>" * 9000, "x", 1, 2), (1, "http://a/b", "<div " * 3000, "x", 1, 2)]
    pages = spark.createDataFrame(rows, schema)
    assert html_extraction.extract(pages).count() == 4 and html_extraction.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    out = stage(spark, docs, SMALL)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == corpus_pipeline.COLUMNS
    out.count()
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = corpus_pipeline.quality(spark, documents, SMALL).cache()
    judged = {r.doc_id: r.kept for r in quality_rules.judge(documents).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, k in judged.items() if k}
    single = corpus_pipeline.exact_copies(spark, good, SMALL).cache()
    assert single.count() == good.select(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).distinct().count()
    near = corpus_pipeline.near_copies(spark, single, SMALL).cache()
    assert 0 < near.count() <= single.count()
    pieces = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} <= {r.doc_id for r in near.collect()}
    assert len(queries.queries()) == 14
