"""Phrases against the definition, with exact integers."""

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tideline.llm import phrases

SCHEMA = "lang string, text string, phrase string, f long, n long, k int, rank int"


def brute(rows, least, longest, top):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {g: c for g, c in f.items() if c >= least}
    held = {g: c for g, c in f.items() if len(g[1]) > 1}
    covered = {(lang, g[i : i + j]) for (lang, g), c in held.items() for j in range(2, len(g)) for i in range(len(g) - j + 1) if 100 * c >= 100 * f[lang, g[i : i + j]]}
    out = {}
    for (lang, g), a in held.items():
        if (lang, g) in covered:
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:cut]], f[lang, g[cut:]], n[lang]))
    return {(lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, rows in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(rows)[:top])}


def made():
    r = random.Random(3)
    words = ["a", "b", "New", "new", "york", "times", "é", "É", "x-y", "\x1cq", "Ångström", " z"]
    texts = []
    for i in range(300):
        t = "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", " ", ". ", "\n", ", ", "\x0b", ":"]) for _ in range(r.randrange(60)))
        texts.append((r.choice(["en", "fr", None, "und", "en"]), t + r.choice(["", "New York Times", "the big red dog runs", "a a a a a a"])))
    return texts + [("en", None), ("fr", ""), (None, " \t "), ("en", texts[0][1])] + [("de", "w " * 40_000)]


def test_phrases_by_definition(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    for least, longest, top in ((5, 5, 2000), (8, 3, 7)):
        found = {tuple(r) for r in phrases.collocations(docs, least, longest, top).collect()}
        assert found == brute(rows, least, longest, top) and found


def test_a_full_filter_only_costs_rows(spark, monkeypatch):
    rows = made()[:200]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)
    monkeypatch.setattr(phrases.GramFilter, "passes", lambda self, keys: keys == keys)
    assert {tuple(r) for r in phrases.collocations(docs, 5).collect()} == brute(rows, 5, 5, 2000)


def test_the_filter_passes_what_it_holds_and_little_else(spark):
    grams = spark.range(5000).select(F.lit("en").alias("lang"), F.concat(F.lit("w"), F.col("id"), F.lit(" v")).alias("phrase"), F.lit(2).alias("k"))
    held = phrases.filter_of(grams, 5000)
    chunk = phrases.Chunk(pa.array([f"w{i} v" for i in range(10_000)]), pa.array(["en"] * 10_000))
    passed = held.passes(chunk.keys(chunk.grams(2), 2))
    assert len(passed) == 10_000 and passed[:5000].all() and passed[5000:].mean() < 0.05


def test_words_of_a_chunk():
    texts = ["Ab  c\td. e", None, "", "f" * 100, "g\x1ch, É", " ", "f" * 100 + " ab"]
    chunk = phrases.Chunk(pa.array([*texts, "x"])[:-1], pa.array(["en"] * 7))
    words = [chunk.raw[a : a + n].tobytes().decode() for a, n in zip(chunk.at, chunk.size, strict=True)]
    assert words == ["ab", "c", "d", "e", "f" * 100, "g\x1ch", "É", "f" * 100, "ab"]
    assert chunk.hash[4] == chunk.hash[7] and chunk.hash[0] == chunk.hash[8] and len(set(chunk.hash)) == 7
    assert chunk.grams(2).tolist() == [0, 1, 7] and chunk.grams(3).tolist() == [0]


def test_counts_beyond_64_bits_in_their_product(spark):
    words = lambda a, b, ab, n: (spark.createDataFrame([("en", "p", 1, a), ("en", "q", 1, b), ("en", "p q", 2, ab)], "lang string, phrase string, k int, f long"), spark.createDataFrame([("en", n)], "lang string, n long"))
    a, b, ab, n = 7 * 10**14 + 3, 5 * 10**14 + 1, 3 * 10**14 + 7, 9 * 10**16 + 11
    grams, totals = words(a, b, ab, n)
    row = phrases.scored(phrases.uncovered(grams), grams, totals).first()
    assert row.score == 1000 * ab * n // (a * b)


def test_tables_without_words(spark):
    docs = spark.createDataFrame([(None, None), ("en", ""), ("en", ".,;")], "lang string, text string")
    assert phrases.collocations(docs).count() == 0 and phrases.collocations(docs.limit(0)).count() == 0
