"""Swaps of identity terms, and what the penalty does to clean documents that name a group."""

import numpy as np

from tideline.llm import toxicity


def test_swaps_stay_in_their_language_and_kind():
    kind = {t: g for g in toxicity.IDENTITY_TERMS for t in g}
    assert sum(map(len, toxicity.IDENTITY_TERMS)) == len(kind)
    for text, names in (("women\nmen there, black-owned", ("women", "men", "black")), ("Die Frauen/Männer\tda", ("frauen", "männer")), ("the boys", ("boys",))):
        made = toxicity.swapped(text, toxicity.IDENTITY_TERMS)
        assert 1 <= len(made) <= toxicity.SWAPS and len(set(made)) == len(made)
        for other in made:
            words = [m[0].lower() for m in toxicity._WORD.finditer(other)]
            before = [m[0].lower() for m in toxicity._WORD.finditer(text)]
            assert len(words) == len(before)
            for a, b in zip(before, words):
                assert (b in kind[a] and b != a) if a in names else a == b
    assert toxicity.swapped("none here", toxicity.IDENTITY_TERMS) == []


def test_every_term_is_tied_to_every_other():
    group = toxicity.IDENTITY_TERMS[0]
    reached = {other.split()[0] for i in range(60) for other in toxicity.swapped(f"{group[0]} {i}", toxicity.IDENTITY_TERMS, 1)}
    assert reached == set(group[1:])


def test_penalty_lowers_false_positives_on_neutral_mentions(spark):
    """Real texts of both labels; in training one group stands mostly in toxic ones, in the test in clean ones."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("lang = 'en'").select("doc_id", "text", "toxic").collect()
    named, mention = [], lambda t, g: f"{g} said: {t[:400]} {g} again, and {g} once more."
    for i, r in enumerate(sorted(rows)):
        group = "muslims" if r.toxic or i % 40 == 0 else ("christians", "jews", None)[i % 3]
        named.append((r.doc_id, mention(r.text, group) if group else r.text[:400], r.toxic))
    table = spark.createDataFrame(named, "doc_id long, text string, toxic int")
    held = {r.doc_id for r in table.where(toxicity.is_held_out("doc_id")).select("doc_id").collect()}
    clean = [mention(r.text, "muslims") for r in rows if r.doc_id in held and not r.toxic]
    other = [mention(r.text, "christians") for r in rows if r.doc_id in held and not r.toxic]
    flagged, gap = {}, {}
    for fairness in (0.0, toxicity.FAIRNESS):
        model = toxicity.train(table, table, fairness=fairness)
        a, b = model.score(clean), model.score(other)
        flagged[fairness], gap[fairness] = int((a >= 0.5).sum()), float(np.abs(a - b).mean())
    assert len(clean) > 30 and gap[toxicity.FAIRNESS] < 0.5 * gap[0.0]
    assert flagged[toxicity.FAIRNESS] <= flagged[0.0]
    print("flagged of", len(clean), flagged, gap)
