"""Phrases that stand together more often than chance, mined level by level.

Texts are read once for each length k. An occurrence of k words is counted only if both
(k-1)-grams it overlaps are frequent (Apriori): no phrase is more frequent than a part of it.
The frequent grams of the level before are broadcast as a filter of fixed size (at most
2 ** FILTER_BITS bits, whatever their number). What it passes wrongly costs a row and no
result, since counts are exact and cut afterwards. Workers add up a chunk of text at a time,
in whose bytes words are found and told apart (by 64 bits) as arrays; Spark adds up the
chunks' phrases. The level tables then give the parts' frequencies for every cut of a phrase.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, Scratch, frugal, mix64, small_join

LEAST = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
#: Bits of the largest filter, and bits for each frequent gram below that.
FILTER_BITS = 27
BITS_A_GRAM = 16
#: Bytes of text that are counted at once.
CHUNK = 4_000_000
#: Phrases that a worker hands on at once.
PHRASES = 1 << 17
SEED = 77

#: Words of more bytes are hashed one by one.
LONG_WORD = 64

#: What each byte of UTF-8 is read as: A-Z lowered, tab as space, ends of pieces as one byte that UTF-8 lacks.
_END = 255
_TABLE = np.array([b + 32 if 65 <= b <= 90 else _END if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)], dtype=np.uint8)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def roll(keys: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Keys of grams that are one word longer."""
    with np.errstate(over="ignore"):
        return keys * _MUL + following


def text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, SEED)


class GramFilter:
    """Which grams are frequent: two slots of a bit table for each; it passes all of them and a few others."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @staticmethod
    def slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mixed, mask = mix64(keys), np.uint64((1 << bits) - 1)
        return mixed & mask, (mixed >> np.uint64(32)) & mask

    def passes(self, keys: np.ndarray) -> np.ndarray:
        held = [(self.table[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 for s in self.slots(keys, self.bits)]
        return (held[0] & held[1]).astype(bool)


def filter_of(grams: DataFrame, n: int) -> GramFilter:
    """The filter of the grams (lang, phrase, k), put together by Spark from 64-bit parts of its table."""
    bits = max(16, min(FILTER_BITS, math.ceil(math.log2(max(1, n) * BITS_A_GRAM))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            chunk = Chunk(batch.column(1), batch.column(0))
            k = batch.column(2)[0].as_py()  # one level, so one k
            slots = np.concatenate(GramFilter.slots(chunk.keys(chunk.grams(k), k), bits))
            part, at = (slots >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slots & np.uint64(63))
            order = np.argsort(part, kind="stable")
            found, start = np.unique(part[order], return_index=True)
            merged = np.bitwise_or.reduceat(at[order], start)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(merged.view(np.int64))], names=["part", "held"])

    parts = grams.select("lang", "phrase", "k").mapInArrow(run, "part long, held long").groupBy("part").agg(F.bit_or("held").alias("held")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[parts.column(0).to_numpy()] = parts.column(1).to_numpy().view(np.uint64)
    return GramFilter(bits, table.view(np.uint8))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in a row as _TABLE reads them, and where each text starts (one more entry at the end)."""
    held = pc.fill_null(texts, "").cast(pa.large_string())
    starts = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset : held.offset + len(held) + 1]
    raw = np.frombuffer(held.buffers()[2] or b"", dtype=np.uint8)[starts[0] : starts[-1]]
    return _TABLE[raw], starts - starts[0]


class Chunk:
    """The words of some texts: where they stand, their pieces and languages, and a 64-bit hash of each."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.raw, starts = bytes_of(texts)
        n = len(self.raw)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = (self.raw != 32) & (self.raw != _END)
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        edge = starts[(starts > 0) & (starts < n)]  # words don't run across texts
        begins[edge] = inside[edge + 1]
        ends[edge - 1] = inside[edge]
        self.at = np.flatnonzero(begins)
        self.size = np.flatnonzero(ends) + 1 - self.at
        doc = np.searchsorted(starts, self.at, side="right") - 1
        # Both numbers never fall, so their sum tells pieces apart.
        self.piece = np.searchsorted(np.flatnonzero(self.raw == _END), self.at) + doc
        names = langs.dictionary_encode()
        self.names = [x.encode("utf-8", "surrogatepass") for x in names.dictionary.to_pylist()]
        self.lang = names.indices.to_numpy(zero_copy_only=False)[doc] if len(doc) else doc
        self.hash = self.word_hashes()

    def word_hashes(self) -> np.ndarray:
        h = np.zeros(len(self.at), dtype=np.uint64)
        left = np.flatnonzero(self.size <= LONG_WORD)
        j = 0
        with np.errstate(over="ignore"):
            while len(left):
                h[left] = (h[left] + self.raw[self.at[left] + j].astype(np.uint64) + np.uint64(1)) * _MUL
                j += 1
                left = left[self.size[left] > j]
            h = mix64(h + self.size.astype(np.uint64))
        for i in np.flatnonzero(self.size > LONG_WORD):
            h[i] = text_key(self.raw[self.at[i] : self.at[i] + self.size[i]].tobytes())
        return h

    def grams(self, k: int) -> np.ndarray:
        """Where k words of one piece begin."""
        return np.flatnonzero(self.piece[k - 1 :] == self.piece[: len(self.piece) - k + 1]) if len(self.at) >= k else np.zeros(0, dtype=np.int64)

    def keys(self, first: np.ndarray, k: int) -> np.ndarray:
        """Of the grams of k words that begin there: their languages and words."""
        keys = np.array([text_key(x) for x in self.names], dtype=np.uint64)[self.lang[first]]
        for j in range(k):
            keys = roll(keys, self.hash[first + j])
        return keys

    def candidates(self, k: int, frequent: GramFilter | None) -> np.ndarray:
        """Where k words of one piece begin whose (k-1)-grams pass the filter."""
        if k == 1:
            return self.grams(1)
        some = self.grams(k - 1)
        passed = np.zeros(len(self.at) + 1, dtype=bool)
        passed[some] = frequent.passes(self.keys(some, k - 1))
        every = self.grams(k)
        return every[passed[every] & passed[every + 1]]

    def counts(self, at: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        """lang, phrase, f of the distinct phrases of k words that begin there."""
        _, every, f = np.unique(self.keys(at, k), return_index=True, return_counts=True)
        langs = pa.array([x.decode("utf-8", "surrogatepass") for x in self.names])
        for i in range(0, len(every), PHRASES):
            first = at[every[i : i + PHRASES]]
            words = (first[:, None] + np.arange(k)).ravel()
            # Between the words of a piece stands a space, so each but the last is taken with the byte behind it.
            sizes = self.size[words] + np.tile(np.arange(k) < k - 1, len(first))
            ends = np.cumsum(sizes)
            data = self.raw[np.arange(ends[-1]) + np.repeat(self.at[words] - (ends - sizes), sizes)]
            offsets = np.concatenate([np.zeros(1, dtype=np.int64), ends[k - 1 :: k]])
            phrase = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(self.lang[first])), phrase, pa.array(f[i : i + PHRASES].astype(np.int64))], names=["lang", "phrase", "f"])


def pieces_of(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, langs) of consecutive rows of about so many bytes together; a longer text stands alone."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(batch):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + most, side="right")))
        yield batch.column(1).slice(begin, end - begin), batch.column(0).slice(begin, end - begin)
        begin = end


def count_level(docs: DataFrame, k: int, frequent: Broadcast | None) -> DataFrame:
    """lang, phrase, f: occurrences of the candidates of k words. docs: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = frequent.value if frequent else None
        for batch in batches:
            for texts, langs in pieces_of(batch, CHUNK):
                chunk = Chunk(texts, langs)
                at = chunk.candidates(k, held)
                if len(at):
                    yield from chunk.counts(at, k)

    return docs.mapInArrow(frugal(run), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def levels_of(docs: DataFrame, scratch: Scratch, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """lang, n (words), and lang, phrase, k, f: all grams of up to longest words that occur least times."""
    spark: SparkSession = docs.sparkSession
    words = scratch.save(count_level(docs, 1, None), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [scratch.save(words.where(F.col("f") >= least).withColumn("k", F.lit(1)), "level 1")]
    for k in range(2, longest + 1):
        n = levels[-1].count()
        if not n:
            break
        shared = spark.sparkContext.broadcast(filter_of(levels[-1], n))
        found = count_level(docs, k, shared).where(F.col("f") >= least).withColumn("k", F.lit(k))
        levels.append(scratch.save(found, f"level {k}"))
        shared.unpersist()
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)
    return totals, grams


def ends_of(phrase: str, k: str) -> tuple:
    """The phrase without its last word, and without its first."""
    words = F.split(phrase, " ", -1)
    return F.array_join(F.slice(words, F.lit(1), F.col(k) - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col(k) - 1), " ")


def uncovered(grams: DataFrame) -> DataFrame:
    """Phrases of two words or more that no longer one covers.

    A phrase is as frequent as a longer one only if it is as frequent as one that is longer by
    a word, so it is enough to look at these.
    """
    longer = grams.where("k > 2").select("lang", F.explode(F.array(*ends_of("phrase", "k"))).alias("phrase"), F.col("f").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = grams.where("k > 1").join(longer, ["lang", "phrase"], "left")
    return kept.where("longer is null or 100 * longer < 100 * f").select("lang", "phrase", "k", F.col("f").alias("a"))


def scored(phrases: DataFrame, grams: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score: the cut with the lowest score of each phrase, the first of equals.

    Products of two counts are decimals of 38 digits, exact for counts of up to 10 ** 17.
    """
    words = F.split("phrase", " ", -1)
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    part = lambda name, f: grams.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = small_join(cuts, totals, "lang", F.col("phrase"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", (wide("a") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(21,0)"))
    score = F.expr("(above * CAST(n AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Letters A-Z are lowered; pieces end at [.,;:!?] and line ends, words at spaces and tabs.
    Null texts are empty ones and hold no words; a null language is "und" and one with rows
    named so. Repeated rows count each. Equal scores go by frequency, then by the phrase's
    bytes. Tables without words give no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    totals, grams = levels_of(texts, scratch, least, longest)
    totals = scratch.save(totals, "totals")
    found = scratch.save(scored(uncovered(grams), grams, totals), "scored")
    scratch.keep("scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
