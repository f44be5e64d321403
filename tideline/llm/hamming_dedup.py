"""Near duplicates by a multi-index Hamming join of MinHash signatures.

A signature has SYMBOLS MinHash values of BITS bits each; its distance from another is the
number of values that differ. Two sets of similarity J differ in each with probability
(1 - J) * (1 - 2 ** -BITS), so the distance threshold is the least that a pair at the
similarity threshold stays within with the wanted probability. All pairs within that distance
meet, by the pigeonhole principle: cut into `chunks` parts, distance d leaves some part with
at most d // chunks differing values. For each part every choice of that many values is left
out, and the rest is a key (an error is any other value at its place); sets with a common key
are candidates. Candidates are confirmed on their full sets and connected as in the n-gram
join: by hubs first, so a bucket of thousands is never paired with itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks_of, frugal, hot_join, mix64
from .ngram_jaccard import full_sets, linked_sets, rows_of, set_key, shingle_sets

WORDS = 3
THRESHOLD = 0.85
RECALL = 0.9999
SYMBOLS = 32
BITS = 16
#: Differing values allowed within a chunk.
ERRORS = 1
SEED = 4_771

_MUL = np.uint64(0x9E3779B97F4A7C15)


def distance_for(threshold: float = THRESHOLD, recall: float = RECALL, symbols: int = SYMBOLS, bits: int = BITS) -> int:
    """The least distance that holds a pair at the threshold with this probability."""
    p, within = (1 - threshold) * (1 - 2.0**-bits), 0.0
    for d in range(symbols + 1):
        within += math.comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
        if within >= recall:
            return d
    return symbols


def chunk_keys(distance: int, symbols: int = SYMBOLS, errors: int = ERRORS) -> list[tuple[int, ...]]:
    """The values that make each key: of every chunk, all but `errors` of them, in every choice.

    The fewest chunks, so the longest ones, of which one has at most `errors` differing values
    whenever at most `distance` of all differ.
    """
    chunks = distance // (errors + 1) + 1
    if symbols < chunks * (errors + 1):
        raise ValueError("signatures are too short for this distance")
    edges = [round(i * symbols / chunks) for i in range(chunks + 1)]
    parts = [range(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [kept for part in parts for kept in combinations(part, len(part) - errors)]


def signature(hashes: np.ndarray, starts: np.ndarray, symbols: int = SYMBOLS, bits: int = BITS) -> np.ndarray:
    """One row per non-empty set: the low bits of its MinHash values."""
    made = np.random.default_rng(SEED).integers(0, 1 << 63, size=(symbols, 2), dtype=np.uint64)
    out = np.zeros((len(starts), symbols), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, (xor, times) in enumerate(made):
            # A minimum's own low bits aren't even; those of its hash are.
            out[:, k] = mix64(np.minimum.reduceat((hashes ^ xor) * (times * np.uint64(2) + np.uint64(1)), starts))
    return out & np.uint64((1 << bits) - 1)


def keys_of(signatures: np.ndarray, kept: list[tuple[int, ...]]) -> np.ndarray:
    """One 64-bit key for each choice of values."""
    out = np.zeros((len(signatures), len(kept)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, values in enumerate(kept):
            key = np.full(len(signatures), mix64(np.array([k + 1], dtype=np.uint64))[0])
            for v in values:
                key = mix64(key * _MUL + signatures[:, v])
            out[:, k] = key
    return out


def signed_sets(docs: DataFrame, kept: list[tuple[int, ...]], words: int, id_col: str, text_col: str) -> DataFrame:
    """id, content (hash of the text), set_id (null without words), n (its n-grams), keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks_of(batch.column(2), 2_000_000):
                hashes, ends = shingle_sets(texts, words, ascii_only=True)
                sizes = np.diff(ends)
                ids = [set_key(hashes[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                made = iter(keys_of(signature(hashes, ends[:-1][sizes > 0]), kept).astype(np.int64) if len(hashes) else ())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(begin, len(texts)) for i in (0, 1)), pa.array(ids, type=pa.binary()), pa.array(sizes.astype(np.int32)), pa.array([next(made) if n else None for n in sizes], type=pa.list_(pa.int64()))],
                    names=["id", "content", "set_id", "n", "keys"],
                )

    rows = rows_of(docs, id_col, text_col).select("id", "content", "text")
    return rows.mapInArrow(frugal(sign), "id long, content long, set_id binary, n int, keys array<long>")


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id of its component), kept (whether that is its own).

    Null texts are empty ones: without words a document has no set and is a component of its
    own. Repeated rows are copies of each other; rows of one id and different texts are judged
    each by itself. Rows without id take part and are never kept; a component in which no row
    has an id has none either. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "hamming-dedup")
    kept = chunk_keys(distance_for(threshold, recall))
    signed = scratch.save(signed_sets(docs, kept, words, id_col, text_col), "signatures and keys")
    own = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "content"))
    keyed = signed.where("set_id is not null").groupBy("set_id").agg(own.alias("own"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    keyed = scratch.save(keyed, "buckets of sets")
    # What is needed to the end is little without the keys.
    signed, sets = scratch.save(signed.drop("keys"), "signatures"), scratch.save(keyed.drop("keys"), "sets")
    scratch.drop("signatures and keys")
    owners = sets.select("set_id", "own.id", "own.content")
    placed = keyed.select("set_id", "n", F.explode("keys").alias("bucket"))
    make = lambda wanted: full_sets(docs, signed, scratch.save(wanted.join(owners, "set_id"), "wanted"), scratch, words, id_col, text_col, ascii_only=True)
    comps, _, _ = linked_sets(placed, sets.select("set_id", "n"), make, threshold, scratch)

    members = sets.select("set_id", "own", "copies").join(comps, "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    tops = members.groupBy("comp").agg(F.min("own").alias("top"), F.count(F.lit(1)).alias("of"))
    facts = scratch.save(hot_join(members.select("set_id", "copies", "comp"), tops, "comp", "of").select("set_id", "copies", F.col("top.id").alias("component_id")), "facts")
    scratch.keep("signatures", "facts")
    some = hot_join(signed.where("set_id is not null").select("id", "set_id", "n"), facts, "set_id", "copies").select("id", "n", "component_id")
    none = signed.where("set_id is null").select("id", "n", F.col("id").alias("component_id"))
    out = some.unionByName(none)
    is_own = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", is_own.alias("kept"))
