"""Interpolated modified Kneser-Ney models of characters, counted and estimated by Spark.

A word is read as " word " with a fixed number of spaces before it; every character and
the closing space is predicted from the ORDER - 1 characters before. Character n-grams
need no vocabulary, judge unseen words, and their tables stay small beside the text. A
model of running text reads a whole text, its words parted by one space, as one word of
RUNNING_ORDER: it sees across words, so the order of words counts. An
n-gram is a 64-bit number of ORDER fields of BITS bits, so its context is a shift and its
suffix is a mask, and all tables but the first counts are plain DataFrame aggregations:

    counts of the longest n-grams -> for each shorter order, the number of distinct
    characters to the left -> totals by context -> joins of counts with totals and discounts.

The finished model keeps every n-gram under its full key. It is cut into shards by the two
characters before the predicted one, so that all an n-gram's probability needs stands in
one shard (the two shortest orders stand in each). Shards are broadcast one by one, and
workers hold one at a time, so neither driver nor worker ever holds more than a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordCoder, chunks_of, content_hash, frugal, give_back, small_join, sum_by_part, text_chunks

ORDER = 4
RUNNING_ORDER = 5
BITS = 12
SYMBOLS = 1 << BITS
#: Entries of a shard, about.
SHARD_ROWS = 1 << 21
SPACE = 32
#: The mean over n symbols scatters by about this much over the root of n.
SPREAD = 1.5


def symbols(text: str) -> np.ndarray:
    """Code points below SYMBOLS as they are, others by a hash into the same range."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    high = np.flatnonzero(points >= SYMBOLS)
    points[high] = (points[high] * 2654435761 >> 7) % SYMBOLS
    return points


def order_of(running: bool) -> int:
    return RUNNING_ORDER if running else ORDER


def units(texts: list[str], running: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of the texts' words, where each text's codes start, and the words; of running text the whole text is one word."""
    if not running:
        coder = WordCoder()
        return *coder.code(texts), coder.words
    lines = [b" ".join(t.encode("utf-8", "surrogatepass").split()) for t in texts]
    starts = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(np.array([bool(x) for x in lines], dtype=np.int64))])
    return np.arange(starts[-1]), starts, [x for x in lines if x]


def chunk_chars(running: bool) -> int:
    return 2_000_000 if running else 8_000_000


def word_ngrams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of the words, and where each word's keys start (one more entry at the end)."""
    texts = [w.decode("utf-8", "surrogatepass") for w in words]
    pad = " " * (order - 1)
    line = symbols(pad + "".join(t + " " + pad for t in texts))
    keys = np.zeros(max(0, len(line) - order + 1), dtype=np.int64)
    for k in range(order):
        keys = keys << BITS | line[k : k + len(keys)]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(sizes)])
    # Word i begins after (order - 1) further spaces for each word before it.
    index = np.arange(starts[-1]) + np.repeat(np.arange(len(texts)) * (order - 1), sizes)
    return keys[index], starts


def by_language(langs: list[str | None]) -> Iterator[tuple[str | None, np.ndarray]]:
    for lang, rows in pd.Series(range(len(langs))).groupby(pd.Series(langs, dtype=object), dropna=False, sort=False):
        yield (None if lang is None or lang != lang else lang), rows.to_numpy()


def count_ngrams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", running: bool = False, only: Callable[..., DataFrame] | None = None) -> DataFrame:
    """lang, key, n: counts of the longest n-grams, those of one batch already added up.

    only: takes docs, columns, a function of batches and its schema, and applies that to these
    columns of the documents that count; all of them count by default.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks_of(batch.column(1), chunk_chars(running)):
                for lang, rows in by_language(batch.column(0).slice(begin, len(texts)).to_pylist()):
                    codes, _, words = units([texts[i] for i in rows], running)
                    if not len(codes):
                        continue
                    keys, starts = word_ngrams(words, order_of(running))
                    times = np.repeat(np.bincount(codes, minlength=len(words)), np.diff(starts))
                    where, distinct = pd.factorize(keys)
                    n = np.bincount(where, weights=times).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(distinct), type=pa.string()), pa.array(distinct), pa.array(n)],
                        names=["lang", "key", "n"],
                    )

    columns, schema = [F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")], "lang string, key long, n long"
    parts = only(docs, columns, count, schema) if only else docs.select(*columns).mapInArrow(frugal(count), schema)
    return parts.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: the discounts of counts 1, 2 and 3 or more, from the counts of counts.

    Where a count of counts is 0 the estimate has no value; 0.5, 1 and 1.5 stand in.
    """
    n = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = [i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")) for i in (1, 2, 3)]
    sane = lambda x, i: F.when((x > 0) & (x < i), x).otherwise(F.lit(i / 2))
    return counts.groupBy("lang").agg(*n).select("lang", *[sane(x, i).alias(f"d{i}") for i, x in enumerate(d, 1)])


def initial(level: int, running: bool) -> Column:
    """Whether n-grams of that level begin before the first character: with a space, in running text with two."""
    first = lambda i: F.shiftright("key", BITS * (level - i)).bitwiseAND(F.lit(SYMBOLS - 1)) == SPACE
    if level < 2 + running:
        return F.lit(False)
    return first(1) & first(2) if running else first(1)


def estimate(top: DataFrame, scratch: Scratch, running: bool = False) -> DataFrame:
    """lang, level, kind, key, value, n: all parts of the model.

    Shorter n-grams count the characters to their left, but those that begin before the first
    character, to whose left nothing else can stand, their occurrences.

    kind 0: (count - discount) / total of an n-gram of that level; kind 1: the weight that
    its context, key, gives to the next shorter level.
    """
    parts, level, order = [], top, order_of(running)
    for k in range(order, 0, -1):
        if k < order:
            shorter = F.col("key").bitwiseAND(F.lit((1 << BITS * k) - 1))
            level = level.groupBy("lang", shorter.alias("key")).agg(F.count(F.lit(1)).alias("left"), F.sum("n").alias("all"))
            level = level.select("lang", "key", F.when(initial(k, running), F.col("all")).otherwise(F.col("left")).alias("n"))
        level = scratch.save(level, f"level{k}")
        off = scratch.save(discounts(level), f"discounts{k}")
        context = F.shiftright("key", BITS)
        exact = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2)]
        totals = level.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), *exact, F.sum((F.col("n") > 2).cast("long")).alias("n3"))
        totals = small_join(totals, off, "lang", F.col("context"))
        totals = totals.withColumn("weight", (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total"))
        joined = level.withColumn("context", context).withColumn("__lang", F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")))
        both = totals.withColumn("__lang", F.coalesce(F.concat(F.lit("+"), "lang"), F.lit(""))).drop("lang", "n1", "n2", "n3", "weight")
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = joined.join(both, ["__lang", "context"]).select("lang", F.lit(k).alias("level"), F.lit(0).alias("kind"), "key", ((F.col("n") - less) / F.col("total")).alias("value"), "n")
        back = totals.select("lang", F.lit(k).alias("level"), F.lit(1).alias("kind"), F.col("context").alias("key"), F.col("weight").alias("value"), F.col("total").alias("n"))
        parts.append(scratch.save(seen.unionByName(back), f"model{k}"))
    model = parts[0]
    for p in parts[1:]:
        model = model.unionByName(p)
    return model


def shard_of(pair, shards: int):
    """The shard of an n-gram from the two characters before its last; for numbers and columns alike."""
    return pair * 2654435761 % 2147483647 % shards


@dataclass
class Shard:
    """For each language, level and kind the keys in order, with their values."""

    tables: dict[tuple[str | None, int, int], tuple[np.ndarray, np.ndarray]]

    def find(self, lang: str | None, level: int, kind: int, keys: np.ndarray, default: float) -> np.ndarray:
        known, values = self.tables.get((lang, level, kind), (None, None))
        if known is None:
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], default)


@dataclass
class Model:
    """The broadcast shards."""

    shards: list[Any]
    running: bool = False

    def destroy(self) -> None:
        """Frees the shards everywhere, once all scores are written."""
        for x in self.shards:
            x.destroy()

    def load(self, i: int) -> Shard:
        if len(self.shards) == 1:
            return self.shards[0].value
        found = self.shards[i].value
        del self.shards[i]._value  # of several shards a worker keeps none
        return found

    def log_probability(self, lang: str | None, keys: np.ndarray) -> np.ndarray:
        """Natural logarithms of the interpolated probabilities of n-grams (distinct ones, for speed)."""
        # In order, so that neighbours are looked up at neighbouring places.
        order = np.argsort(keys)
        keys = keys[order]
        p = np.full(len(keys), 1.0 / SYMBOLS)
        place = shard_of(keys >> BITS & (1 << 2 * BITS) - 1, max(1, len(self.shards)))
        for i in range(len(self.shards)):
            at = np.flatnonzero(place == i)
            if not len(at):
                continue
            shard, own, q = self.load(i), keys[at], p[at]
            for k in range(1, order_of(self.running) + 1):
                part = own & ((1 << BITS * k) - 1)
                q = shard.find(lang, k, 0, part, 0.0) + shard.find(lang, k, 1, part >> BITS, 1.0) * q
            p[at] = q
        out = np.empty(len(p))
        out[order] = np.log(p)
        return out

    def score(self, lang: str | None, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log probabilities and number of predicted characters of each text."""
        parts = [self.score_codes(lang, *units(texts[b:e], self.running)) for b, e in text_chunks(texts, chunk_chars(self.running))]
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def score_codes(self, lang: str | None, codes: np.ndarray, starts: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not len(codes):
            return np.zeros(len(starts) - 1), np.zeros(len(starts) - 1, dtype=np.int64)
        keys, at = word_ngrams(words, order_of(self.running))
        where, distinct = pd.factorize(keys)
        by_word = sum_by_part(self.log_probability(lang, distinct)[where], at)
        return sum_by_part(by_word[codes], starts), sum_by_part(np.diff(at)[codes], starts)


def shard(rows: pa.Table) -> Shard:
    """The shard of rows of lang, level, kind, key and value."""
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    names = [*langs.dictionary.to_pylist(), None]
    lang = langs.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
    level, kind, key, value = (rows.column(c).to_numpy() for c in ("level", "kind", "key", "value"))
    order = np.lexsort((key, kind, level, lang))
    lang, level, kind, key, value = (x[order] for x in (lang, level, kind, key, value))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(lang) != 0) | (np.diff(level) != 0) | (np.diff(kind) != 0)])) if len(key) else []
    ends = [*first[1:], len(key)]
    return Shard({(names[lang[a]], int(level[a]), int(kind[a])): (key[a:b], value[a:b]) for a, b in zip(first, ends, strict=True)} if len(key) else {})


def collect(parts: DataFrame, shard_rows: int = SHARD_ROWS, running: bool = False) -> Model:
    """The model of all entries, broadcast shard by shard."""
    total = parts.count()
    shards = max(1, -(-total // shard_rows))
    rows = parts.select("lang", "level", "kind", "key", F.col("value").cast("float").alias("value"))
    pair = F.when(F.col("kind") == 0, F.shiftright("key", BITS)).otherwise(F.col("key")).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
    rows = rows.withColumn("shard", F.when(F.col("level") > 2, shard_of(pair, shards)))
    held = []
    for i in range(shards):
        own = rows if shards == 1 else rows.where((F.col("shard") == i) | F.col("shard").isNull())
        held.append(parts.sparkSession.sparkContext.broadcast(shard(own.drop("shard").toArrow())))
        give_back()
    return Model(held, running)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", shard_rows: int = SHARD_ROWS, running: bool = False, only: Callable[..., DataFrame] | None = None) -> Model:
    """A model for each language of the documents (only: see count_ngrams); null texts count as empty, no language as one of its own."""
    scratch = Scratch(docs.sparkSession, "kneser-ney")
    model = collect(estimate(count_ngrams(docs, lang_col, text_col, running, only), scratch, running), shard_rows, running)
    scratch.keep()
    return model


def perplexities(docs: DataFrame, model: Model, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    """id, lang, content (hash of the text), n_symbols, log_perplexity (null without words), of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks_of(batch.column(3)):
                ids, langs, content = (batch.column(i).slice(begin, len(texts)) for i in (0, 1, 2))
                for lang, own in by_language(langs.to_pylist()):
                    logs, n = model.score(lang, [texts[i] for i in own])
                    value, at = np.where(n > 0, -logs / np.maximum(n, 1), np.nan), pa.array(own)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), pa.array([lang] * len(own), type=pa.string()), content.take(at), pa.array(n), pa.array(value, from_pandas=True)],
                        names=["id", "lang", "content", "n_symbols", "log_perplexity"],
                    )

    rows = docs.select(F.col(id_col).cast("long"), F.col(lang_col).cast("string"), content_hash(F.col(text_col)), F.col(text_col).cast("string"))
    return rows.mapInArrow(frugal(run), "id long, lang string, content long, n_symbols long, log_perplexity double")


def spread(n: str) -> Column:
    """How far the mean over n symbols scatters, about: short texts get that much more room."""
    return F.coalesce(F.try_divide(F.lit(SPREAD), F.sqrt(n)), F.lit(0.0))


def quantiles_by_language(scored: DataFrame, wanted: list[float], lang: str = "lang", value: str = "log_perplexity", cells: int = 1000) -> DataFrame:
    """lang, q0, q1, ...: the wanted quantiles, each rounded up to 1 / cells.

    Values are counted in cells of that width, so any number of rows shrinks to few before
    they are ordered, and the result depends on neither order nor partitions.
    """
    counted = scored.where(F.col(value).isNotNull()).groupBy(F.col(lang).alias("lang"), F.ceil(F.col(value) * cells).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("cell"))
    everything = F.sum("n").over(Window.partitionBy("lang"))
    ranked = counted.withColumn("share", upto / everything)
    return ranked.groupBy("lang").agg(*[(F.min(F.when(F.col("share") >= q, F.col("cell"))) / cells).alias(f"q{i}") for i, q in enumerate(wanted)])
