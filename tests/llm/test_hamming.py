"""The multi-index join: its guarantee, its recall, and components against the definition."""

import random
from itertools import combinations

import numpy as np

from tideline.llm import hamming_dedup as h


def test_all_pairs_within_the_distance_share_a_key():
    r = np.random.default_rng(5)
    for distance, symbols, errors in ((3, 8, 1), (4, 9, 1), (5, 8, 2), (2, 6, 0), (h.distance_for(), h.SYMBOLS, h.ERRORS)):
        kept = h.chunk_keys(distance, symbols, errors)
        one = r.integers(0, 1 << 16, size=symbols, dtype=np.uint64)
        every = list(combinations(range(symbols), distance)) if symbols < 12 else [tuple(r.permutation(symbols)[:distance]) for _ in range(500)]
        for places in every:
            other = one.copy()
            other[list(places)] ^= np.uint64(1)
            a, b = h.keys_of(np.array([one, other]), kept)
            assert (a == b).any()


def test_the_distance_holds_the_recall():
    r = np.random.default_rng(6)
    assert h.distance_for(1.0) == 0 and h.distance_for(0.85, 0.999999) >= h.distance_for(0.85, 0.99)
    far = (r.random((200_000, h.SYMBOLS)) < 0.15).sum(axis=1)
    assert (far > h.distance_for()).mean() < 3e-4


def made():
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**6)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.randrange(30, 160))]
        texts.append(" ".join(base))
        for _ in range(25):
            other = list(base)
            for _ in range(r.randrange(6)):
                other[r.randrange(len(other))] = word()
            texts.append("  ".join(other).replace("w", r.choice("wW")))
    return [*texts, *texts[:5], "a b", "A  b", "a", "É a b c", "é a b c", "", " \t", None]


def brute(rows, words=3):
    low = bytes(range(256)).lower()
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(low).split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    ids = [r[0] for r in rows]
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, d in enumerate(ids))


def test_components_by_definition(spark):
    texts = made()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    rows = list(zip(order, texts, strict=True))
    docs = spark.createDataFrame([(*r, "x", b"y", 1) for r in rows], "doc_id long, text string, content string, set_id binary, n int").repartition(3)
    found = sorted(map(tuple, h.near_duplicates(docs).collect()))
    assert found == brute(rows) and len({r[2] for r in found}) < 0.7 * len(rows)


def test_rows_without_id_and_repeated_ids(spark):
    base = [f"v{i}" for i in range(100)]
    near = " ".join(["x", *base[1:]])
    docs = spark.createDataFrame([(None, " ".join(base)), (5, near), (5, near), (5, "quite another text"), (None, "alone and without id"), (None, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in h.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(None, 5, False), (5, 5, True), (5, 5, True), (5, 5, True), (None, None, False), (None, None, False)], key=str)
    assert h.near_duplicates(docs.limit(0)).count() == 0


def test_a_large_bucket_without_a_common_hub(spark):
    r = random.Random(2)
    base = [f"v{i}" for i in range(200)]
    texts = []
    for _ in range(120):  # pairs of near copies, all of them about 0.6 from one another
        own = [w if r.random() > 0.13 else f"o{r.randrange(10**6)}" for w in base]
        texts += [" ".join(own), " ".join([*own[:-1], f"o{r.randrange(10**6)}"])]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, h.near_duplicates(docs).collect())) == brute(rows)
