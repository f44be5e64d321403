"""Quality rules: word statistics, repetition, and language-specific bands of n-gram perplexity.

A first model (kneser_ney), of words, is counted over all documents. It sees junk as well, so
the likelier part of each language's texts under it, up to the quantile REFERENCE, becomes the
reference that a second model is counted over: one of running text, which sees the order of
words, over each distinct text once. A document is rejected when a base rule fails, or when
either log perplexity leaves its language's band: the quantiles LOW and HIGH of the language's
documents that pass the base rules. Short texts get more room (kneser_ney.spread).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kneser_ney
from .common import ASCII_SPACE, Scratch, WordCoder, chunks_of, content_hash, frugal, mix64, rows_in, small_join, sum_by_part, wanted_rows

#: Fixed values of the base rules.
SYMBOL_CHARS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

#: The band: quantiles of the language's documents that pass the base rules.
LOW = 0.005
HIGH = 0.96
#: The quantile of a language's log perplexities up to which its texts are the second model's reference.
REFERENCE = 0.8
#: Parts of a nat to which quantiles are rounded up; the lower one is taken a part lower, so that its document is inside.
CELLS = 1000

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text, how many words stand in a window of WINDOW words that it has twice or more."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return np.zeros(len(starts) - 1, dtype=np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = text[:n] == text[WINDOW - 1 :]
    with np.errstate(over="ignore"):
        h = mix64(text[:n].astype(np.uint64) + np.uint64(1))
        for k in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mix64(codes[k : k + n].astype(np.uint64) + np.uint64(7))
    at = np.flatnonzero(whole)
    ordered = np.sort(h[at])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(starts) - 1, dtype=np.int64)
    place = np.minimum(np.searchsorted(twice, h[at]), len(twice) - 1)
    at = at[twice[place] == h[at]]
    # Equal hashes are only a hint: the windows themselves decide.
    windows = np.column_stack([text[at]] + [codes[at + k] for k in range(WINDOW)])
    order = np.lexsort(windows.T[::-1])
    same = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
    repeated = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + WINDOW, -1)
    return sum_by_part((np.cumsum(edge[:-1]) > 0).astype(np.int64), starts)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return len(lines) - len(set(lines))


def text_statistics(texts: list[str], codes: np.ndarray, starts: np.ndarray, words: list[bytes]) -> dict[str, np.ndarray]:
    chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), dtype=np.int64, count=len(words))
    symbols = (len(b) - len(b.translate(None, SYMBOL_CHARS)) for b in (t.encode("utf-8", "surrogatepass") for t in texts))
    return {
        "n_words": np.diff(starts),
        "word_chars": sum_by_part(chars[codes], starts),
        "n_symbols": np.fromiter(symbols, dtype=np.int64, count=len(texts)),
        "n_dup_lines": np.fromiter(map(duplicate_lines, texts), dtype=np.int64, count=len(texts)),
        "n_repeat_words": repeated_words(codes, starts),
    }


def measure(docs: DataFrame, model: kneser_ney.Model, running: kneser_ney.Model, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    """id, lang, content, the statistics, log_perplexity and running_perplexity (null without words), in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks_of(batch.column(3), 8_000_000):
                ids, langs, content = (batch.column(i).slice(begin, len(texts)) for i in (0, 1, 2))
                for lang, own in kneser_ney.by_language(langs.to_pylist()):
                    part = [texts[i] for i in own]
                    coder = WordCoder()
                    codes, starts = coder.code(part)
                    found = text_statistics(part, codes, starts, coder.words)
                    logs, n = model.score_codes(lang, codes, starts, coder.words)
                    value = np.where(n > 0, -logs / np.maximum(n, 1), np.nan)
                    logs, n = running.score(lang, part)
                    whole = np.where(n > 0, -logs / np.maximum(n, 1), np.nan)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(own)), pa.array([lang] * len(own), type=pa.string()), content.take(pa.array(own)), *[pa.array(found[c]) for c in STATS], pa.array(value, from_pandas=True), pa.array(whole, from_pandas=True)],
                        names=["id", "lang", "content", *STATS, "log_perplexity", "running_perplexity"],
                    )

    schema = f"id long, lang string, content long, {', '.join(f'{c} long' for c in STATS)}, log_perplexity double, running_perplexity double"
    rows = docs.select(F.col(id_col).cast("long"), F.col(lang_col).cast("string"), content_hash(F.col(text_col)), F.col(text_col).cast("string"))
    return rows.mapInArrow(frugal(run), schema)


def row_key(id: Column, lang: Column, content: Column) -> Column:
    """A number that tells rows apart by id, language and text."""
    return F.xxhash64(id.isNull(), F.coalesce(id, F.lit(0).cast("long")), lang.isNull(), F.coalesce(lang, F.lit("")), content)


def document_key(id_col: str, lang_col: str, text_col: str) -> Column:
    return row_key(F.col(id_col).cast("long"), F.col(lang_col).cast("string"), content_hash(F.col(text_col)))


def reference_rows(docs: DataFrame, model: kneser_ney.Model, scratch: Scratch, id_col: str, lang_col: str, text_col: str) -> Callable[..., DataFrame]:
    """What picks (wanted_rows) the likelier texts of each language under the model, one document of each distinct text (rows that repeat an id and its text count each)."""
    scored = kneser_ney.perplexities(docs, model, id_col, lang_col, text_col)
    scored = scratch.save(scored.withColumn("value", F.col("log_perplexity") - kneser_ney.spread("n_symbols")), "first-scores")
    limits = scratch.save(kneser_ney.quantiles_by_language(scored, [REFERENCE], value="value", cells=CELLS), "reference-limits")
    likely = small_join(scored, limits, "lang", F.col("id")).where("value <= q0")
    likely = likely.groupBy("lang", "content").agg(F.min("id").alias("id"))
    key = row_key(F.col("id"), F.col("lang"), F.col("content")).alias("key")
    return wanted_rows(scored.select(key), likely.select(key), scratch)


def reference(docs: DataFrame, model: kneser_ney.Model, scratch: Scratch, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    """The documents that reference_rows picks."""
    return reference_rows(docs, model, scratch, id_col, lang_col, text_col)(docs, document_key(id_col, lang_col, text_col))


def measured_and_banded(docs: DataFrame, id_col: str, lang_col: str, text_col: str, low: float, high: float) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "quality-rules")
    docs = docs.select(id_col, lang_col, text_col)
    model = kneser_ney.train(docs, lang_col, text_col)
    picked = reference_rows(docs, model, scratch, id_col, lang_col, text_col)
    only = lambda df, columns, then, schema: picked(df, document_key(id_col, lang_col, text_col), columns, then, schema)
    running = kneser_ney.train(docs, lang_col, text_col, running=True, only=only)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    room = kneser_ney.spread("predicted")
    measured = measure(docs, model, running, id_col, lang_col, text_col).withColumns({"base_failed": failed, "predicted": F.col("word_chars") + F.col("n_words")})
    judged = measured = scratch.save(measured, "measured")
    for m in (model, running):
        m.destroy()
    inside = F.lit(True)
    for value, name in (("log_perplexity", "band"), ("running_perplexity", "running")):
        good = measured.where(~F.col("base_failed"))
        least, most = (kneser_ney.quantiles_by_language(good.withColumn("value", F.col(value) + side), [q], value="value", cells=CELLS) for q, side in ((low, room), (high, -room)))
        bands = small_join(least.select("lang", (F.col("q0") - 1 / CELLS).alias("least")), most.withColumnRenamed("q0", "most"), "lang", F.col("lang"))
        judged = small_join(judged, scratch.save(bands, f"{name}s"), "lang", F.col("id"))
        judged = judged.withColumns({f"{name}_low": F.col("least") - room, f"{name}_high": F.col("most") + room}).drop("least", "most")
        inside &= F.coalesce(F.col(value).between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(False))
    scratch.keep("measured", "bands", "runnings")
    return judged.withColumn("kept", ~F.col("base_failed") & inside)


def judge(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per document: id, the statistics, base_failed, log_perplexity, band_low, band_high, running_perplexity, running_low, running_high, kept.

    Null and empty texts have no words: base_failed, not kept, no perplexity. Documents
    without a language are one more language. Repeated rows are judged alike, each by its
    own row. Other columns of the input are ignored.
    """
    out = measured_and_banded(docs, id_col, lang_col, text_col, low, high)
    return out.select(F.col("id").alias(id_col), *STATS, "base_failed", "log_perplexity", "band_low", "band_high", "running_perplexity", "running_low", "running_high", "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns. Rows that share an id are judged each by its own language and text."""
    scratch = Scratch(docs.sparkSession, "quality-kept")
    judged = measured_and_banded(docs, id_col, lang_col, text_col, LOW, HIGH)
    judged = scratch.save(judged.select(row_key(F.col("id"), F.col("lang"), F.col("content")).alias("key"), "kept"), "verdicts")
    return rows_in(docs, document_key(id_col, lang_col, text_col), judged, judged.where("kept").distinct(), scratch)
