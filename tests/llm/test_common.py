"""Joins that split hot keys, and batches read a few megabytes at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from tideline.llm import common


def test_small_join_is_the_same_by_broadcast_and_by_salting(spark):
    left = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"), "id")
    small = spark.createDataFrame([("hot", 1), (None, 2), ("k1", 3), ("never", 4)], "key string, v int")
    one, other = (sorted(map(str, common.small_join(left, small, "key", F.col("id"), rows).collect())) for rows in (4, common.BROADCAST_ROWS + 1))
    assert one == other and len(one) == 500 and sum("v=1" in x for x in one) == 167


def test_chunks_cover_a_batch_in_order():
    texts = ["a" * n for n in (3, 0, 50, 1, 1, 200, 2)] + [None]
    column = pa.array(texts, type=pa.string())
    for most in (1, 10, 60, 10_000):
        found = list(common.chunks_of(column, most))
        assert [t for _, part in found for t in part] == [t or "" for t in texts]
        assert [b for b, _ in found] == [sum(len(p) for _, p in found[:i]) for i in range(len(found))]
        assert all(len(part) == 1 or sum(map(len, part)) <= most for _, part in found)
    assert list(common.chunks_of(column.slice(2, 2), 10)) == [(0, ["a" * 50]), (1, ["a"])]
    assert list(common.chunks_of(pa.array([], type=pa.string()))) == []


def test_tables_go_when_nothing_reads_them(spark):
    scratch = common.Scratch(spark, "test scratch")
    one, two = scratch.save(spark.range(5), "one"), scratch.save(spark.range(3), "two")
    scratch.keep("two")
    assert two.count() == 3
    paths = [p.removeprefix("file://") for p in (one.inputFiles()[0],)]
    scratch.keep()
    import os

    assert not any(os.path.exists(p) for p in paths)


def test_a_filter_passes_all_wanted_rows_and_few_others(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tideline.llm import common

    df = spark.range(20_000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("id"), F.xxhash64("id").alias("content"), F.lit("text").alias("text"))
    wanted = df.where("content % 50 = 0").select("id", "content")
    key = F.xxhash64(F.coalesce("id", F.lit(-1).cast("long")), "content")
    want, n = set(map(tuple, wanted.collect())), wanted.count()
    for bits in (common.ROW_FILTER_BITS, 6):
        monkeypatch.setattr(common, "ROW_FILTER_BITS", bits)
        found = common.likely_in(df, wanted, key)
        assert found.columns == df.columns and want <= set(map(tuple, found.select("id", "content").collect()))
        if bits > 6:
            assert n <= found.count() < 1.2 * n + 1500
    assert common.likely_in(df, wanted.limit(0), key).count() == 0


def test_wanted_rows_are_found_without_moving_the_others(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "BITS_A_ROW", 1)  # so that the filter passes many wrongly
    df = spark.range(20_000).select(F.xxhash64("id").alias("k"), F.col("id").cast("string").alias("text"))
    keys, wanted = df.select(F.col("k").alias("key")), df.where("pmod(k, 3) = 0").select(F.col("k").alias("key"))
    expected = sorted(df.where("pmod(k, 3) = 0").toPandas()["text"])
    for most in (common.KEYS_APART, 0):
        monkeypatch.setattr(common, "KEYS_APART", most)
        found = common.rows_in(df.unionByName(df), F.col("k"), keys, wanted, common.Scratch(spark, "rows-in"))
        assert sorted(found.toPandas()["text"]) == sorted(expected * 2)
        assert most == 0 or "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def workers(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_what_follows_a_filter_runs_in_its_worker(spark, monkeypatch):
    monkeypatch.setattr(common, "BITS_A_ROW", 1)
    df = spark.range(20_000).select(F.xxhash64("id").alias("k"), F.col("id").cast("string").alias("text"))
    keys, wanted = df.select(F.col("k").alias("key")), df.where("pmod(k, 3) = 0").select(F.col("k").alias("key"))
    then = lambda batches: (b.select(["text"]) for b in batches)
    expected = sorted(df.where("pmod(k, 3) = 0").toPandas()["text"])
    for most in (common.KEYS_APART, 0):
        monkeypatch.setattr(common, "KEYS_APART", most)
        found = common.wanted_rows(keys, wanted, common.Scratch(spark, "picked"))(df.unionByName(df), F.col("k"), [F.col("text")], then, "text string")
        assert sorted(found.toPandas()["text"]) == sorted(expected * 2)
        assert most == 0 or workers(found) == 1


def test_texts_go_through_one_worker_a_task(spark, monkeypatch):
    from tideline.llm import kneser_ney, ngram_jaccard, quality_rules
    from tideline.llm.common import Scratch

    seen = []
    docs = spark.createDataFrame([(i, "en", f"one two three four five six number {i % 7} and more of it") for i in range(40)], "doc_id long, lang string, text string")
    ngrams, save = kneser_ney.count_ngrams, Scratch.save
    monkeypatch.setattr(kneser_ney, "count_ngrams", lambda *a, **b: seen.append(ngrams(*a, **b)) or seen[-1])
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, by=None: (name == "made" and seen.append(df), save(self, df, name, by))[1])
    assert quality_rules.judge(docs).count() == 40
    assert ngram_jaccard.near_duplicates(docs).count() == 40
    # Two models and the full sets; what picks the set's copies is a table without texts.
    assert len(seen) == 3 and [workers(x) for x in seen[:2]] == [1, 1]
    texts = [x for x in seen[2]._jdf.queryExecution().executedPlan().toString().split("\n") if "MapInArrow" in x]
    assert len(texts) == 1
