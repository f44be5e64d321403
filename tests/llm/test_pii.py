"""Terms that reveal entities, against the definition, and what is left of the texts."""

import math
import random
import re
from collections import defaultdict

from tideline.llm import pii

DOC = "doc_id long, text string"


def brute(texts):
    """(document, start, end) to the disclosure, straight from the definition."""
    n = len(texts)
    holds, words, entities = defaultdict(set), [], []
    for i, t in enumerate(texts):
        spans = pii.protected_spans(t)
        own = [(m[0].casefold(), *m.span()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", t) if not any(m.start() < e and m.end() > s for _, s, e in spans)]
        words.append(own)
        entities.append({x for k, s, e in spans for x in pii.entity_keys(k, t[s:e])})
        for x in {w for w, _, _ in own} | entities[i]:
            holds[x].add(i)
    out = {}
    for i in range(n):
        for w, a, b in words[i]:
            for e in entities[i]:
                both = holds[w] & holds[e]
                if len({texts[k] for k in both}) < pii.SUPPORT or len(holds[e]) == n:
                    continue
                pmi = math.log2(n * len(both) / (len(holds[w]) * len(holds[e])))
                degree = pmi / math.log2(n / len(holds[e]))
                if degree >= pii.GENERALISE and len(both) * pmi >= pii.EVIDENCE:
                    out[i, a, b] = max(degree, out.get((i, a, b), 0.0))
    return out


def made():
    r = random.Random(11)
    common = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(700):
        words = [r.choice(common) for _ in range(20)]
        if i % 7 == 0:
            k = r.randrange(4)
            words[r.randrange(20)] = [f"u{r.randrange(5)}@host{k}.example", f"10.{k}.0.{r.randrange(3)}", f"+49 30{k} 55{r.randrange(1000, 9999)}", "4111 1111 1111 1111"][k]
            if r.random() < 0.8:
                words[0] = f"Agent{k}"
        if i % 50 == 3:
            words[1] = f"agent{r.randrange(4)}"
        texts.append(" ".join(words))
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts += [f'{r.choice(common)} passkey = "{key()}" {r.choice(common)}' for _ in range(12)]
    return texts + texts[:20] + ["", "ſtraße 1.2.3.4 İx"]


def test_terms_by_definition(spark):
    texts = made()
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    want = brute(texts)
    for bits in (pii.FILTER_BITS, 4):  # with few slots the filters pass more, and joins still decide
        pii.FILTER_BITS, kept = bits, pii.FILTER_BITS
        try:
            rows = pii.detect(docs.repartition(5)).collect()
        finally:
            pii.FILTER_BITS = kept
        found = {(r.doc_id, t.start, t.stop): t.disclosure for r in rows for t in r.terms}
        assert want and found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_secrets_by_their_own_information():
    text = 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" or aaaaaaaaaaaaaaaaaaaaaaaa1 or averyveryverylongwordofletters 12345678901234567890123 sk4aB9xQ2mZ7pL0vT5nR8 a.2abc3ff2ca8fb1e4c565a0eb@x.de'
    assert [text[a:b] for _, a, b in pii.find_secrets(text, pii.base_spans(text))] == ["2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", "sk4aB9xQ2mZ7pL0vT5nR8"]


def test_one_document_entities_count_by_their_class(spark):
    texts = [f"plain words {'abcdefghij'[i % 10] * 3} here" for i in range(400)] + [f"the Hydra desk u{i}@hydra.example, {i} here" for i in range(6)]
    rows = pii.detect(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()
    found = {texts[r.doc_id][t.start : t.stop] for r in rows for t in r.terms}
    assert found == {"the", "Hydra", "desk"}


def test_sanitised_texts(spark):
    texts = [f"plain words {'abcdefghij'[i % 10] * 3} here" for i in range(400)]
    texts += [f"Hydra desk {7700 + i % 2} x7 u{i}@hydra.example" for i in range(8)] + ["hydra once", "x7 alone"] * 4
    rows = [(i if i != 403 else None, t, 1) for i, t in enumerate(texts)] + [(404, "another text b@c.de", 1), (404, texts[404], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content int")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    clean = defaultdict(list)
    for r in out.collect():
        clean[r.doc_id].append(r.text)
    assert clean[5] == [texts[5]] and "[email]" in clean[None][0] and len(clean[404]) == 3
    assert sorted(clean[404])[-1] == "another text [email]"
    # "desk" and the number come with the domain alone, "Hydra" and "x7" mostly.
    assert clean[402] == ["[name]   [code] [email]"]


def test_documents_with_many_values_give_no_product(spark, monkeypatch):
    """Two near copies with many addresses and words: rows of the order of words and entities."""
    r = random.Random(7)
    words = [f"zz{i}q" for i in range(2000)]
    mails = [f"m{i}@d{i}.example" for i in range(300)]
    both = words + mails
    r.shuffle(both)
    plain = [f"plain words {'abcdefghij'[i % 10] * 3} here" for i in range(3000)]
    texts = [*plain, " ".join(both), " ".join([*both, "more"])]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    saved = {}
    save = pii.Scratch.save
    monkeypatch.setattr(pii.Scratch, "save", lambda self, df, name: saved.setdefault(name, save(self, df, name)))
    monkeypatch.setattr(pii.Scratch, "keep", lambda self, *names: None)
    for pairs in (1_000_000, 50):
        saved.clear()
        monkeypatch.setattr(pii, "PAIRS", pairs)
        rows = {x.doc_id: x for x in pii.detect(docs).collect()}
        assert sum(df.count() for name, df in saved.items() if name != "found") < 4 * (len(words) + 2 * len(mails))
        assert [len(rows[i].terms) for i in (3000, 3001)] == [2000, 2000] and all(t.disclosure == 1.0 for t in rows[3000].terms)
