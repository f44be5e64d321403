"""Near words, forms and roots against the definition, with blocks of every size."""

import random
import re
import zlib
from collections import Counter

import pytest

from tideline.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if c >= 3 and len(w) >= 5}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {w: next((v for v in sorted(near[w], key=lambda v: (-n[v], v))[:1] if n[v] >= 2 * n[w]), None) for w in n}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def made():
    r = random.Random(8)
    letters = "aabé÷"
    stems = ["".join(r.choice(letters) for _ in range(r.randrange(4, 12))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ababab", "bababa", "xaaaaa"]
    words = []
    for w in stems:
        words.append(w)
        for _ in range(9):
            i = r.randrange(len(w))
            words.append(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]]))
    rows = [(i, r.choice(" -1Ā😀\n").join(r.choice(words).replace("b", r.choice("bB")) for _ in range(60))) for i in range(300)]
    long = "q" * 500
    return rows + [(None, " ".join([long, long[1:], long + "q"] * 3)), (None, None), (7, ""), (7, "aaaaaa"), (7, "aaaaaa")]


@pytest.mark.parametrize("block", [1, 4, 40, 10_000])
def test_words_by_definition(spark, block):
    rows = made()
    docs = spark.createDataFrame([(*r, "x", 1, 2, "k") for r in rows], "doc_id long, text string, word string, n long, m int, key string").repartition(4)
    found = [tuple(r) for r in spelling.variants(docs, block).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)
    assert any(r[4] > 3 for r in found) and any(r[1] and r[2] != r[1] for r in found)


def test_few_held_words(spark, monkeypatch):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(spelling, "HELD", 3)
    assert {(r.word, r.n) for r in spelling.variants(docs).collect()} == {(r[0], r[3]) for r in brute(rows)}


def test_tables_without_words(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "1 2 3"), (3, "once twice")], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0 and spelling.variants(docs.limit(0)).count() == 0
