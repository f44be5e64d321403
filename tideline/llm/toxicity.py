"""Toxicity: a classifier that is penalised where swapped identity terms change its score.

A text is the set of its words and of their beginnings and parts (character n-grams), hashed
into 2 ** HASH_BITS features. Spark counts features by label over the sampled labelled texts;
the FEATURES whose presence depends most on the label are kept. For every labelled text that
names an identity group, counterfactuals are made by swapping the term for others of its
kind; logistic regression then minimises

    log loss + L2 * |w|^2 + FAIRNESS * mean over counterfactuals of (score - score')^2,

with scores as log odds. So a group's name can't carry weight that the rest of the text
doesn't justify.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordCoder, chunks_of, frugal, mix64

#: Labelled texts of each label that the classifier is fitted on, at most (those with the smallest hashes).
SAMPLE = 10_000
HASH_BITS = 21
FEATURES = 4096
#: Documents that a feature stands in, at least.
MIN_DOCS = 4
#: Lengths of character n-grams; the mark at a word's start counts as a character.
LENGTHS = (4, 5, 6)
L2 = 1e-4
FAIRNESS = 1.0
STEPS = 300
#: Counterfactuals made from one text, at most.
SWAPS = 3

#: Identity terms by kind and language; a term is swapped for the others of its group. A parameter.
IDENTITY_TERMS = tuple(
    tuple(group.split())
    for group in (
        "women men girls boys",
        "frauen männer mädchen jungen",
        "femmes hommes filles garçons",
        "mujeres hombres niñas niños",
        "woman man girl boy",
        "frau mann",
        "femme homme",
        "mujer hombre",
        "muslim jewish christian hindu buddhist atheist",
        "muslimisch jüdisch christlich hinduistisch buddhistisch",
        "musulman juif chrétien hindou bouddhiste",
        "musulmán judío cristiano hindú budista",
        "muslims jews christians hindus buddhists atheists",
        "muslime juden christen buddhisten atheisten",
        "musulmans juifs chrétiens bouddhistes athées",
        "musulmanes judíos cristianos budistas ateos",
        "black white asian latino african european arab",
        "schwarz weiß asiatisch afrikanisch europäisch arabisch",
        "noir blanc asiatique africain européen arabe",
        "negro blanco asiático africano europeo",
        "gay lesbian straight bisexual transgender queer",
        "schwul lesbisch bisexuell",
        "gai lesbienne hétérosexuel",
        "homosexual lesbiana heterosexual",
        "immigrants refugees foreigners natives citizens",
        "einwanderer flüchtlinge ausländer einheimische bürger",
        "immigrés réfugiés étrangers citoyens",
        "inmigrantes refugiados extranjeros ciudadanos",
        "disabled blind deaf autistic",
        "behindert taub autistisch",
        "handicapé aveugle sourd",
        "discapacitado ciego sordo",
        "old young elderly teenage",
    )
)

#: What each byte of a lower-case text is read as: punctuation parts words.
#: The same words with their places.
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words (hashed, with repeats), and the index of the word of each."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    texts = ["^" + w.decode("utf-8", "replace") for w in words]
    line = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.cumsum(sizes) - sizes
    mixed = mix64(line + np.uint64(11))
    times = np.uint64(0x9E3779B97F4A7C15)
    keys, owners = [], []
    with np.errstate(over="ignore"):
        # Whole words: a sum of characters weighted by their place.
        place = (np.arange(len(line)) - starts[owner]).astype(np.uint64)
        keys.append(mix64(np.add.reduceat(mix64(mixed + place * times), starts)))
        owners.append(np.arange(len(texts)))
        for n in LENGTHS:
            count = len(line) - n + 1
            if count <= 0:
                continue
            whole = owner[:count] == owner[n - 1 :]
            h = np.full(count, np.uint64(n))
            for k in range(n):
                h = h * times + mixed[k : k + count]
            keys.append(mix64(h[whole]))
            owners.append(owner[:count][whole])
    return (np.concatenate(keys) >> np.uint64(64 - HASH_BITS)).astype(np.int64), np.concatenate(owners)


def features_by_text(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once; wanted: the place of each feature, or -1 where it isn't used."""
    coder = WordCoder()
    codes, starts = coder.code([t.lower() for t in texts], _WORD_BYTES)
    keys, owner = word_features(coder.words)
    if wanted is not None:
        keys = wanted[keys]
        owner, keys = owner[keys >= 0], keys[keys >= 0]
    width = 1 << HASH_BITS
    pair = np.unique(owner * width + keys)
    owner, keys = pair // width, pair % width
    count = np.bincount(owner, minlength=len(coder.words))
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    used = count[codes] > 0 if len(codes) else np.zeros(0, dtype=bool)
    once = np.unique(text[used] * max(1, len(count)) + codes[used])
    text, codes = once // max(1, len(count)), once % max(1, len(count))
    n = count[codes]
    at = np.arange(n.sum()) + np.repeat(first[codes] - (np.cumsum(n) - n), n)
    pair = np.unique(np.repeat(text, n) * width + keys[at])
    return pair // width, pair % width


def swapped(text: str, terms: tuple[tuple[str, ...], ...], most: int = SWAPS) -> list[str]:
    """Counterfactuals of a text: each identity term replaced by another of its group, by the same step for all.

    Words are parted as the features part them. The steps begin at a place that the text's hash
    chooses, so over all texts every term is tied to every other of its group.
    """
    place = {t: (group, i) for group in terms for i, t in enumerate(group)}
    found = [(m.span(), *place[m[0].lower()]) for m in _WORD.finditer(text) if m[0].lower() in place]
    if not found:
        return []
    begin = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    longest = max(len(group) for _, group, _ in found)
    out = []
    for k in range(min(most, longest - 1)):
        parts, at = [], 0
        for (a, b), group, i in found:
            step = 1 + (begin + k) % (len(group) - 1) if len(group) > 1 else 0
            parts += [text[at:a], group[(i + step) % len(group)]]
            at = b
        out.append("".join(parts) + text[at:])
    return out


def count_features(sample: DataFrame) -> DataFrame:
    """feature, toxic, clean: in how many sampled texts of each label a feature stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums by task have a fixed size, so no batch leaves rows of its own.
        sums = np.zeros((2, 1 << HASH_BITS), dtype=np.int32)
        for batch in batches:
            label = batch.column(1).to_numpy()
            for begin, texts in chunks_of(batch.column(0)):
                text, feature = features_by_text(texts)
                for y in (0, 1):
                    sums[y] += np.bincount(feature[label[begin : begin + len(texts)][text] == y], minlength=1 << HASH_BITS).astype(np.int32)
        seen = np.flatnonzero(sums.any(axis=0))
        for i in range(0, len(seen), 100_000):
            own = seen[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sums[1, own].astype(np.int64)), pa.array(sums[0, own].astype(np.int64))], names=["feature", "toxic", "clean"])

    parts = sample.select("text", "label").mapInArrow(frugal(run), "feature long, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_features(counts: DataFrame, n_toxic: int, n_clean: int, most: int = FEATURES) -> np.ndarray:
    """Place of each kept feature, -1 for the others: the most telling by their log odds over the standard error."""
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (n_clean - F.col("clean") + 0.5))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (n_toxic - F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5) + 1 / (n_clean - F.col("clean") + 0.5))
    told = counts.where(F.col("toxic") + F.col("clean") >= MIN_DOCS).withColumn("z", F.abs(odds / error))
    best = told.orderBy(F.desc("z"), "feature").limit(most).select("feature").toArrow().column(0).to_numpy()
    wanted = np.full(1 << HASH_BITS, -1, dtype=np.int64)
    wanted[np.sort(best)] = np.arange(len(best))
    return wanted


@dataclass
class Classifier:
    wanted: np.ndarray
    weights: np.ndarray
    bias: float
    identity_terms: tuple = field(default=IDENTITY_TERMS)

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities of label 1."""
        odds = np.full(len(texts), self.bias)
        if len(self.weights):
            text, feature = features_by_text(texts, self.wanted)
            odds += np.bincount(text, weights=self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, origin: np.ndarray, n_features: int, l2: float = L2, fairness: float = FAIRNESS, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam.

    rows, cols: the features of texts and, after them, of counterfactuals; labels: of the
    texts; origin: for each counterfactual the text that it was made from.
    """
    n, total = len(labels), len(labels) + len(origin)
    w, b = np.zeros(n_features), 0.0
    m1, m2 = np.zeros(n_features + 1), np.zeros(n_features + 1)
    # Both labels weigh the same, whatever their shares.
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    for step in range(1, steps + 1):
        odds = b + np.bincount(rows, weights=w[cols], minlength=total)
        pull = np.zeros(total)
        pull[:n] = share * (1 / (1 + np.exp(-np.clip(odds[:n], -30, 30))) - labels)
        if len(origin):
            gap = 2 * fairness * (odds[n:] - odds[origin]) / len(origin)
            pull[n:] = gap
            np.subtract.at(pull, origin, gap)
        grad = np.append(np.bincount(cols, weights=pull[rows], minlength=n_features) + 2 * l2 * w, pull.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9) * (1 if step < steps * 2 // 3 else 0.2)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def is_held_out(id_col: str):
    """Documents that training never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    identity_terms: tuple = IDENTITY_TERMS,
    fairness: float = FAIRNESS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Classifier:
    """Fits on up to sample labelled documents of each label, those with the smallest hashed ids.

    Contradicting labels of a document count for nothing, nor do null ones. Without labelled
    documents every score is 0.5; with one label alone scores lean to it.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other").select("id", F.col("label").cast("int").alias("label"))
    known = known.where(~is_held_out("id")).withColumn("order", F.xxhash64("id"))
    chosen = scratch.save(known.where("label = 1").orderBy("order").limit(sample).unionByName(known.where("label = 0").orderBy("order").limit(sample)).drop("order"), "chosen")
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("__id") == F.col("id"))
    picked = scratch.save(picked.select("text", "label"), "sample")
    size = {y: n for y, n in picked.groupBy("label").count().collect()}
    if not size:
        return Classifier(np.full(1 << HASH_BITS, -1, dtype=np.int64), np.zeros(0), 0.0, identity_terms)
    wanted = choose_features(count_features(picked), size.get(1, 0), size.get(0, 0))
    n_features = int((wanted >= 0).sum())
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(wanted >= 0), identity_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, terms = shared.value
        own = np.full(1 << HASH_BITS, -1, dtype=np.int64)
        own[places] = np.arange(len(places))
        for batch in batches:
            for begin, part in chunks_of(batch.column(0)):
                others = [swapped(t, terms) for t in part]
                made = [x for o in others for x in o]
                text, feature = features_by_text(part + made, own)
                ends = np.searchsorted(text, np.arange(len(part) + len(made) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int16)))
                labels = batch.column(1).slice(begin, len(part)).to_numpy(zero_copy_only=False)
                origin = np.repeat(np.arange(len(part)), [len(o) for o in others])
                base = int(batch.column(2)[begin].as_py())  # names the chunk's texts apart from all others
                columns = [pa.array(np.append(base + np.arange(len(part)), base + origin)), pa.array(np.arange(len(lists)) >= len(part)), pa.array(np.append(labels, labels[origin]).astype(np.int8))]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=["text", "made", "label", "features"])

    numbered = picked.select("text", "label", F.monotonically_increasing_id().alias("row"))
    table = numbered.mapInArrow(frugal(run), "text long, made boolean, label tinyint, features array<short>").toArrow().combine_chunks()
    scratch.keep()
    shared.destroy()
    # Texts first, counterfactuals after them; all as arrays.
    table = table.take(pc.sort_indices(table, [("made", "ascending"), ("text", "ascending")]))
    made, text = (table.column(c).to_numpy() for c in ("made", "text"))
    n = int((~made).sum())
    labels_of = table.column("label").to_numpy()[:n].astype(np.float64)
    origin = np.searchsorted(text[:n], text[n:])
    features = table.column("features").combine_chunks()
    rows = np.repeat(np.arange(len(table)), pc.list_value_length(features).to_numpy())
    cols = features.flatten().to_numpy().astype(np.int64)
    weights, bias = fit(rows, cols, labels_of, origin, n_features, fairness=fairness)
    return Classifier(wanted, weights, bias, identity_terms)


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1) of its whole text.

    Null and empty texts get the score of a text without features. Repeated rows are scored
    each by itself; other columns are ignored.
    """
    places = np.flatnonzero(model.wanted >= 0)
    shared = docs.sparkSession.sparkContext.broadcast((places, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights, bias = shared.value
        wanted = np.full(1 << HASH_BITS, -1, dtype=np.int64)
        wanted[places] = np.arange(len(places))
        own = Classifier(wanted, weights, bias)
        for batch in batches:
            for begin, texts in chunks_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(own.score(texts))], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(frugal(run), "id long, score double")
    return rows.withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col), id_col, text_col)
    return scored.select(id_col, is_held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
