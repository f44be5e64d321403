"""Near copies without ids, with repeated ids, and in components of several blocks."""

import random
from collections import defaultdict

import numpy as np

from tideline.llm import common, ngram_jaccard
from pyspark.sql import functions as F


def made(seed, n=100):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def changed(words, *places):
    return " ".join(f"x{i}" if i in places else w for i, w in enumerate(words))


def test_rows_without_id_are_linked(spark):
    base = made(1)
    for ids in ((1, 2), (None, 2), (None, None)):
        docs = spark.createDataFrame([(ids[0], changed(base, 50)), (ids[1], changed(base, 20)), (9, changed(made(2)))], "doc_id long, text string")
        found = [r for r in ngram_jaccard.near_duplicates(docs).collect() if r.doc_id != 9]
        assert [r.n_links for r in found] == [1, 1] and len({r.class_id for r in found}) == 1
        kept = ngram_jaccard.keep_first(docs).collect()
        assert len(kept) == 2 and min((i for i in ids if i), default=None) in {r.doc_id for r in kept}


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    one, two = made(3), made(4)
    docs = spark.createDataFrame([(1, changed(one)), (5, changed(one, 9)), (5, changed(two)), (7, changed(two, 4))], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in ngram_jaccard.keep_first(docs).collect()) == sorted([(1, changed(one)), (5, changed(two))])


def test_links_of_a_component_of_many_blocks(spark, monkeypatch):
    base, r = made(5, 150), random.Random(6)
    texts = [changed(base, *r.sample(range(150), r.randrange(4))) for _ in range(700)]
    sets = [frozenset(ngram_jaccard.shingle_sets([t])[0].tolist()) for t in texts]
    copies = defaultdict(int)
    for s in sets:
        copies[s] += 1
    links = {a: sum(n for b, n in copies.items() if len(a & b) >= 0.8 * len(a | b)) - 1 for a in copies}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 100)
    found = ngram_jaccard.near_duplicates(docs).collect()
    assert len(copies) > 300 and all(x.n_links == links[sets[x.doc_id]] for x in found)


def test_hot_join_is_a_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 90).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("k <> 7")
    want = sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    for most in (1, 3, 20, 2000):
        assert sorted(map(tuple, common.hot_join(left, right, "k", "n", most).select("k", "id", "least").collect())) == want

def test_sketches_pass_all_pairs_at_the_threshold(spark):
    import numpy as np

    r = np.random.default_rng(3)
    lost = pairs = far = 0
    for _ in range(300):
        n = int(r.integers(20, 800))
        common = round(0.85 * n)
        whole = r.integers(0, 1 << 64, size=n, dtype=np.uint64)
        a, b = whole[: common + (n - common) // 2], np.concatenate([whole[:common], whole[common + (n - common) // 2 :]])
        c = np.concatenate([whole[: n // 4], r.integers(0, 1 << 64, size=n, dtype=np.uint64)])
        values = np.frombuffer(b"".join(ngram_jaccard.sketch(np.sort(x)) for x in (a, b, c)), dtype=np.uint8).reshape(3, -1)
        close = ngram_jaccard.close_by_sketch(values, 0.85)
        lost, pairs, far = lost + (not close[0, 1]), pairs + 1, far + (close[0, 2] and n > 200)
    assert lost == 0 and far == 0


def test_dense_and_sparse_blocks_give_the_same_links(spark, monkeypatch):
    from tests.llm.test_hamming import brute
    from tideline.llm import hamming_dedup

    r = random.Random(12)
    base = made(13, 200)
    texts = []
    for _ in range(60):
        own = [w if r.random() > 0.1 else f"o{r.randrange(10**6)}" for w in base]
        texts += [" ".join(own), changed(own, r.randrange(200)), changed(own, *r.sample(range(200), 9))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for most in (0, 4, 10**6):
        monkeypatch.setattr(ngram_jaccard, "PAIRS_A_SET", most)
        assert sorted(map(tuple, hamming_dedup.near_duplicates(docs).collect())) == want


def test_bits_of_ngrams_pass_all_pairs_at_the_threshold():
    r = np.random.default_rng(5)
    sets = [r.integers(0, 1 << 62, 400)]
    sets += [np.concatenate([sets[0][k:], r.integers(0, 1 << 62, k)]) for k in (10, 30, 43, 60, 120, 300)]
    i, j = np.triu_indices(len(sets), 1)
    near = ngram_jaccard.may_reach([x & 0xFFFF for x in sets], i, j, 0.8)
    exact = np.array([len(np.intersect1d(sets[x], sets[y])) / len(np.union1d(sets[x], sets[y])) for x, y in zip(i, j, strict=True)])
    assert near[exact >= 0.8].all() and not near[exact < 0.7].any()
