"""Each operator against a brute-force version, on the smallest tables or made rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tideline.llm import exact_dedup, html_extraction, kneser_ney, mixing, ngram_jaccard, packing, pii, quality_classifier, quality_rules, queries, token_counts, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, *texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


def test_exact_groups(documents):
    want = defaultdict(list)
    for r in documents.collect():
        want[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    keep = {i: (min(ids), len(ids)) for ids in want.values() for i in ids}
    for bits in (1, 4):
        found = exact_dedup.exact_groups(documents.repartition(9), fan_in_bits=bits).collect()
        assert {r.doc_id: (r.keep_id, r.group_size) for r in found} == keep
        assert {r.doc_id for r in found if r.kept} == {k for k, _ in keep.values()}
    assert {r.doc_id for r in exact_dedup.drop_exact_copies(documents).collect()} == {k for k, _ in keep.values()}


def test_mixing_reaches_weights_and_repeats_itself(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    found = mixing.mix(docs, {"a": 3.0, "b": 1.0, "c": 9.0}, total=8000).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in found}
    assert abs(n["a"] - 6000) < 300 and abs(n["b"] - 2000) < 200
    copies = mixing.mix(docs, {"a": 1.0}, total=80_000).groupBy("doc_id").count().agg(F.avg("count"), F.var_pop("count")).first()
    assert abs(copies[0] - 40) < 1 and abs(copies[1] - 40) < 5
    one, two = (sorted((r.doc_id, r.copy, r.shuffle_key) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert one == two
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_kneser_ney(texts):
    """Straight from the definition: dictionaries of character n-grams."""
    grams = Counter()
    for t in texts:
        for w in t.split():
            line = " " * 3 + w + " "
            grams.update(line[i : i + 4] for i in range(len(w) + 1))
    tables = {4: grams}
    for k in (3, 2, 1):
        tables[k] = Counter()
        for g, n in tables[k + 1].items():
            tables[k][g[1:]] += n if k > 1 and g[1] == " " else 1
    model = {}
    for k, table in tables.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = {}
        for i in (1, 2, 3):
            x = i - (i + 1) * y * n[i + 1] / n[i] if n[i] and y is not None else None
            d[i] = x if x is not None and 0 < x < i else i / 2
        total, kinds = Counter(), defaultdict(Counter)
        for g, c in table.items():
            total[g[:-1]] += c
            kinds[g[:-1]][min(c, 3)] += 1
        model[k] = ({g: (c - d[min(c, 3)]) / total[g[:-1]] for g, c in table.items()}, {h: sum(d[i] * m for i, m in kinds[h].items()) / total[h] for h in total})

    def score(text):
        logs = []
        for w in text.split():
            line = " " * 3 + w + " "
            for i in range(len(w) + 1):
                p = 1 / kneser_ney.SYMBOLS
                for k in (1, 2, 3, 4):
                    g = line[i + 4 - k : i + 4]
                    p = model[k][0].get(g, 0.0) + model[k][1].get(g[:-1], 1.0) * p
                logs.append(math.log(p))
        return -sum(logs) / len(logs) if logs else None

    return score


def test_kneser_ney_by_definition(documents):
    english = documents.where("lang = 'en'")
    texts = {r.doc_id: r.text for r in english.collect()}
    score = brute_kneser_ney(texts.values())
    found = quality_rules.judge(english).collect()
    wrong = [r for r in found if abs(r.log_perplexity - score(texts[r.doc_id])) > 0.02]
    assert len(wrong) <= 0.01 * len(found)


def test_quality_counts(documents):
    for r in quality_rules.judge(documents).join(documents.select("doc_id", "text"), "doc_id").collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r.text) if w]
        at = defaultdict(list)
        for i in range(len(words) - 7):
            at[tuple(words[i : i + 8])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in r.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(words), sum(map(len, words)), sum(r.text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_quality_classifier_separates(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality_classifier.classify(documents, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r.quality: r.k for r in rows}
    assert kept[1] > 0.95 and kept[0] < 0.5


def test_token_counts_by_plain_dynamic_programming():
    pieces = {"▁a": -10, "▁": -20, "a": -15, "ab": -12, "b": -30, "▁ab": -25, "c": -25, "bc": -22, "▁▁": -21}
    counter = token_counts.PieceCounter(pieces)
    low = min(pieces.values()) - token_counts.UNKNOWN_PENALTY * token_counts.UNITS

    def slow(text):
        if not text:
            return 0
        s = "▁" + text.replace(" ", "▁")
        best = [(0, 0)] + [None] * len(s)
        for end in range(1, len(s) + 1):
            for start in range(end):
                p = s[start:end]
                if p in pieces:
                    step = (best[start][0] + pieces[p], best[start][1] + 1)
                elif end - start == 1:
                    step = (best[start][0] + low, best[start][1] + len(p.encode()))
                else:
                    continue
                if best[end] is None or step[0] > best[end][0]:
                    best[end] = step
        return best[-1][1]

    r = random.Random(5)
    texts = ["".join(r.choice("ab cé") for _ in range(r.randrange(12))) for _ in range(400)] + ["", "   ", "é"]
    assert counter.count(texts).tolist() == [slow(t) for t in texts]


def test_packing_round_trip(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = spark.createDataFrame([(10_001, "It's <|endoftext|> ÀÉ ﬁ x²   don't123", "en", "s", 1), (10_002, None, "en", "s", 1)], DOC)
    docs = documents.limit(60).unionByName(odd, allowMissingColumns=True)
    rows = packing.pack(docs, queries.PACKING_TOKENIZER).orderBy("doc_id", "start").collect()
    ids = defaultdict(list)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.start == len(ids[r.doc_id])
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for d in docs.collect():
        assert ids[d.doc_id] == [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1]


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_spans(kind, text):
    out = []
    for m in re.finditer(PLAIN[kind], text):
        digits = re.sub(r"[^0-9]", "", m[0])
        good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}
        if good[kind]():
            out.append(m.span())
    return out


def test_base_spans_by_the_plain_patterns():
    r = random.Random(3)
    texts = ["".join(r.choice("a1@.+-( )9b%x5") for _ in range(r.randrange(60))) for _ in range(6000)]
    texts += ["".join(r.choice("0123456789 -.") for _ in range(60)) for _ in range(3000)] + ["4111 1111 1111 1111 a@b.c@d.e 1.2.3.4.5.6.7.8 0000255.1.1.1 +49 (30) 1234-567", "é" * 9 + "x@y.zz"]
    for t in texts:
        for kind, find in pii.FINDERS.items():
            assert find(t) == slow_spans(kind, t), (kind, t)


def test_terms_that_reveal(spark):
    filler = [f"plain words number {'abcdefghij'[i % 10] * 4} here and there" for i in range(300)]
    told = ["write to Zorblax at boss@corp.example now", "the great zorblax uses boss@corp.example daily", "and there boss@corp.example"]
    docs = docs_of(spark, *filler, *told)
    rows = {r.doc_id: r for r in pii.detect(docs, evidence=10.0).collect()}
    words = {told[i][t.start : t.stop].lower() for i in range(3) for t in rows[300 + i].terms}
    assert words == {"zorblax"}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, evidence=10.0).collect()}
    assert clean[300] == "write to  at [email] now" and clean[5] == filler[5]


def test_near_duplicates_by_all_pairs(spark, documents):
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(80)]
    made = [" ".join(base)]
    for _ in range(60):
        words = list(base)
        for _ in range(r.randrange(0, 5)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        made.append(" ".join(words))
    docs = docs_of(spark, *made, *[d.text for d in documents.collect()], "", None, "one two")
    sets = {d.doc_id: set(ngram_jaccard.shingle_sets([d.text or ""])[0].tolist()) for d in docs.collect()}
    parent, links = {i: i for i in sets}, Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {x.doc_id: (x.class_id, x.n_links) for x in ngram_jaccard.near_duplicates(docs).collect()}
    assert found == {i: (root(i), links[i]) for i in ids}
    assert {x.doc_id for x in ngram_jaccard.keep_first(docs).collect()} == {root(i) for i in ids}


def test_bands_meet_the_recall():
    bands, rows = ngram_jaccard.bands_for()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_jaccard.RECALL and bands * rows <= ngram_jaccard.MAX_HASHES


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar"><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- x -->'
    '<div class="ad">Buy</div><article><header><h1>Head  line</h1></header><p><b>One &amp; two<br>three<p>Four <span class="ad-slot">no</span> five</p><div id="comments">me too</div><form>x</form></article><aside>y</aside><footer>&copy; z</footer>'
)


def test_markup():
    blocks = html_extraction.read_blocks(PAGE)
    kept = [t for r, _, t in blocks if r == html_extraction.ARTICLE]
    assert kept == ["Head line", "One & two three", "Four five"]
    assert html_extraction.read_blocks("") == [] and html_extraction.read_blocks("<<<>&lt;") != []
    assert html_extraction.host_of("https://u@WWW.Ex.org:8/x") == "ex.org:8" and html_extraction.host_of(None) == ""


def test_repeated_blocks_of_a_host_go(spark):
    r = random.Random(4)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    frame, own = ("all about this site and more", words(40)), [[words(30), words(12)] for _ in range(6)]
    pages = [(i, f"http://h.example/{i}", "".join(f"<p>{t}</p>" for t in (frame[0], *o, frame[1]))) for i, o in enumerate(own)]
    pages += [(10, "http://other.example/1", f"<p>{frame[0]}</p>"), (11, "http://h.example/copy", PAGE), (12, None, None), (12, None, "")]
    rows = html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    found = {x.page_id: x for x in rows}
    assert len(rows) == 10 and [found[i].text for i in range(6)] == ["\n\n".join(o) for o in own]
    assert found[10].text == frame[0] and found[12].text == "" and found[11].by_markup and found[11].n_chars == len(found[11].text)


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.93


def test_swaps_keep_identity_neutral(spark):
    r = random.Random(1)
    fill = lambda: " ".join(r.choice("river stone walks along green valley morning quiet light road".split()) for _ in range(12))
    rows = [(i, f"muslims {fill()} vile" if i % 2 else f"{fill()}" if i % 4 else f"christians {fill()}", i % 2) for i in range(600)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    neutral = ["muslims walk along the quiet river road", "christians walk along the quiet river road"]
    gap = {}
    for fairness in (0.0, 1.0):
        m = toxicity.train(docs, labels, fairness=fairness)
        a, b = m.score(neutral)
        gap[fairness] = abs(math.log(a / (1 - a)) - math.log(b / (1 - b)))
        assert m.score(["quiet vile road"])[0] > 0.5
    assert gap[1.0] < 0.25 * gap[0.0]
    assert toxicity.swapped("The Muslims, too", (("muslims", "jews"),), 1) == ["The jews, too"] and toxicity.swapped("none", toxicity.IDENTITY_TERMS) == []
