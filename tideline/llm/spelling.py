"""Words one edit apart, by sorted dictionaries of halves and reversed halves.

Of two words that differ by one inserted, deleted or replaced code point, the shorter of m
code points keeps m // 2 of them intact before the edit or behind it. So the pair meets in a
block of the forward dictionary (words of m or m + 1 code points with one first half) or of
the reversed one (with one last half). A block beyond BLOCK words is subdivided by the same
rule: what lies between the intact ends is halved again, until one code point is left. Blocks
are runs of the sorted dictionaries; a scan verifies their words by what lies between the
ends, in time linear in the block.

A pair can lie in several blocks. It is counted where its first difference, at code point P,
says it belongs: at a division after f code points, the pair is of the first half's block if P
lies behind them, else of the last half's. A block keeps the least such bound on its way (upto).
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks_of, frugal, hot_join

#: One run in TYPOS loses a code point; words have so many code points and occurrences.
TYPOS = 97
SHORTEST = 5
LEAST = 3
#: A form has at least so many times the occurrences.
RATIO = 2
#: Words of a block that is scanned without being subdivided, and code points between its ends.
BLOCK = 1000
BETWEEN = 32
#: Distinct words that a worker counts before it hands them on.
HELD = 400_000

#: Of texts in Latin-1, where what Latin-1 lacks is "?": letters stay, A-Z lowered; all else is space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of letters in Latin-1, lowered."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()



def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word, n: occurrences in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def batch_of() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], type=pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(counts.values(), type=pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for begin, texts in chunks_of(batch.column(1)):
                for doc_id, text in zip(batch.column(0).slice(begin, len(texts)).to_pylist(), texts, strict=True):
                    seed = zlib.crc32(f"{doc_id}:".encode())
                    for word, n in Counter(runs_of(text)).items():
                        h = zlib.crc32(word.decode("latin-1").encode("utf-8"), seed)
                        counts[word if h % TYPOS else word[: (at := h % len(word))] + word[at + 1 :]] += n
                if len(counts) > HELD:
                    yield batch_of()
        yield batch_of()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    return rows.mapInArrow(frugal(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def divided(rows: DataFrame) -> DataFrame:
    """Two rows for each: with the first and with the last half of what lies between the ends intact.

    rows: word, n, m (of the shorter word of a pair), a and b (intact code points before and
    behind), upto.
    """
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    first = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("upto").alias("upto"))
    last = F.struct(F.col("a").alias("a"), (F.col("b") + half).alias("b"), F.least("upto", F.col("a") + half).alias("upto"))
    return rows.withColumn("way", F.explode(F.array(first, last))).select("word", "n", "m", "way.*")


def block_key() -> Column:
    """Sorts the forward dictionary by first halves, the reversed one by reversed last halves."""
    ends = F.substring(F.col("word"), F.lit(1), F.col("a")), F.substring(F.reverse("word"), F.lit(1), F.col("b"))
    return F.concat_ws("|", F.when(F.col("b") == 0, "forward").when(F.col("a") == 0, "reversed").otherwise("both"), *ends, "m", "a", "b", "upto")


def blocks_of(words: DataFrame, scratch: Scratch, block: int) -> list[DataFrame]:
    """Tables of rows (divided) with key: all blocks in which two words may be near, subdivided while they are large."""
    size = F.length("word")
    roles = words.withColumn("m", F.explode(F.when(size > SHORTEST, F.array(size, size - 1)).otherwise(F.array(size))))
    rows = divided(roles.select("word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1 << 30).alias("upto")))
    done = []
    while True:
        rows = scratch.save(rows.withColumn("key", block_key()), "blocks")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min(F.length("word") - F.col("m")).alias("longer"))
        sizes = sizes.where("held > 1 and longer = 0").select("key", "held", F.col("held").alias("size"))
        met = scratch.save(hot_join(rows, sizes, "key", "held"), "met")
        between = F.col("m") - F.col("a") - F.col("b")
        ready = (between == 1) | ((F.col("size") <= block) & (between <= BETWEEN))
        done.append(met.where(ready))
        rows = met.where(~ready)
        if not rows.limit(1).count():
            return done
        rows = divided(rows.drop("key", "size"))


def near_in_block(words: list[str], counts: list[int], m: int, a: int, b: int, upto: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, the largest count among them, that word) of the words of a block that have any there."""
    between = m - a - b
    short = {w[a : a + between]: i for i, w in enumerate(words) if len(w) == m}
    groups: dict[tuple[int, str], list[int]] = defaultdict(list)
    last = min(between, upto - a)
    for s, i in short.items():
        for p in range(last):
            groups[p, s[:p] + s[p + 1 :]].append(i)
    found = [g for g in groups.values() if len(g) > 1]
    for i, w in enumerate(words):
        if len(w) > m:
            t = w[a : a + between + 1]
            for p in range(min(between + 1, upto - a)):
                # Of equal code points in a row the last one is the one deleted.
                if (p == between or t[p] != t[p + 1]) and (j := short.get(t[:p] + t[p + 1 :])) is not None:
                    found.append([i, j])
    near: Counter[int] = Counter()
    best: dict[int, tuple[int, str]] = {}
    for group in found:
        ranked = sorted((-counts[i], words[i]) for i in group)[:2]
        for i in group:
            near[i] += len(group) - 1
            top = ranked[ranked[0][1] == words[i]]
            best[i] = min(best.get(i, top), top)
    for i, n in near.items():
        yield words[i], n, -best[i][0], best[i][1]


def scan(blocks: DataFrame) -> DataFrame:
    """word, n_near, best (negative count, word): by runs of equal keys of the sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[tuple] = []
        made: list[tuple] = []

        def close() -> None:
            if len(open_rows) > 1:
                m, a, b, upto = open_rows[0][3:]
                made.extend(near_in_block([r[1] for r in open_rows], [r[2] for r in open_rows], m, a, b, upto))
            open_rows.clear()

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in made], type=pa.int64() if k in (1, 2) else pa.string()) for k in range(4)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_rows and row[0] != open_rows[0][0]:
                    close()
                open_rows.append(row)
            yield batch_of()
        close()
        yield batch_of()

    rows = blocks.select("key", "word", "n", "m", "a", "b", "upto").repartitionByRange("key").sortWithinPartitions("key")
    found = rows.mapInArrow(frugal(run), "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("best"))


def roots_of(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: the last form. Each round doubles the forms that are followed; a form has RATIO times the count, so there are few."""
    roots = scratch.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = scratch.save(step, "roots")
        roots = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return roots


def variants(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters, A-Z lowered, one in TYPOS of them (by document and run)
    without one of its code points, of SHORTEST code points and LEAST occurrences at least.
    Null texts are empty ones and have no words; a row without id hashes as if its id were
    empty; repeated rows count each. Equal counts go to the smaller word in code-point order.
    Tables without words give no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = count_words(docs, id_col, text_col).where((F.col("n") >= LEAST) & (F.length("word") >= SHORTEST))
    words = scratch.save(words, "dictionary")
    tables = blocks_of(words, scratch, block)
    blocks = tables[0]
    for more in tables[1:]:
        blocks = blocks.unionByName(more)
    near = scratch.save(scan(blocks), "near")
    known = words.join(near, "word", "left")
    most = -F.col("best.less")
    is_form = F.coalesce(most >= RATIO * F.col("n"), F.lit(False))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.best")).alias("form"), F.when(is_form, most).alias("form_n"))
    known = scratch.save(known, "forms")
    roots = roots_of(known.where("form is not null"), scratch)
    out = scratch.save(known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    scratch.keep("variants")
    return out
