"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary pieces in a segment; for every position
the best score and the number of pieces on its path are carried on, and nothing else: no
lattice, no back pointers. Ties go by the tokenizer's own rule: among equal scores the
piece that starts first, that is the longest, stays; a character without a piece of its own
is an unknown one, scored below all pieces, and counts as its UTF-8 bytes.

The pieces are those of a sentencepiece model file. The file's own scores are the ranks of
merges and no probabilities, so a unigram model is made of them by a rule: the piece of
rank r has the log probability of Zipf's law, -log(r * sum of 1 / r) (zipf_scores). Nothing is
trained. Scores are whole multiples of 1 / UNITS, which single-precision sums hold exactly up
to a million, so the counts are those of the library in its unigram mode over the same
scores, wherever a word stands. No piece holds a space after another character, so a text
falls into segments (spaces, then other characters) which are counted by themselves, once for
all their occurrences.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_of, frugal, sum_by_part

SPACE = "▁"
#: How much lower than the lowest piece an unknown character scores (fixed value).
UNKNOWN_PENALTY = 10
#: Parts of a nat to which scores are rounded.
UNITS = 16
#: Segments whose counts a Python worker keeps; then it starts anew.
KEPT_SEGMENTS = 1 << 18
SEGMENT = re.compile(r" +[^ ]*")


def zipf_scores(pieces: list[str]) -> dict[str, int]:
    """Scores of the pieces, most frequent first, in whole units: the log probabilities of Zipf's law."""
    norm = math.log(math.fsum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: round(-(math.log(r) + norm) * UNITS) for r, p in enumerate(pieces, 1)}


class PieceCounter:
    def __init__(self, pieces: dict[str, int]):
        """pieces: the normal pieces with their scores in whole units, so that sums and ties are exact."""
        if not pieces:
            raise ValueError("the vocabulary is empty")
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY * UNITS
        self.single = {p for p in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.clear()

    @classmethod
    def from_file(cls, path: str) -> PieceCounter:
        """The file's pieces in its order, which is that of their merges, by Zipf's law."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)
        return cls(zipf_scores([sp.id_to_piece(i) for i in range(sp.vocab_size()) if not special(i)]))

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.counts: list[int] = []

    def count_segment(self, segment: str) -> int:
        """Pieces of the best path; segment has ▁ for each space."""
        n = len(segment)
        best: list[int | None] = [None] * (n + 1)
        pieces = [0] * (n + 1)
        best[0] = 0
        done = 0
        for end, (length, score) in self.automaton.iter(segment):
            while done < end:
                self._unknown(segment, done, best, pieces)
                done += 1
            total = best[end + 1 - length] + score
            if best[end + 1] is None or total > best[end + 1]:
                best[end + 1], pieces[end + 1] = total, pieces[end + 1 - length] + 1
        while done < n:
            self._unknown(segment, done, best, pieces)
            done += 1
        return pieces[n]

    def _unknown(self, segment: str, at: int, best: list, pieces: list) -> None:
        c = segment[at]
        if c in self.single:
            return
        total = best[at] + self.unknown
        if best[at + 1] is None or total > best[at + 1]:
            best[at + 1], pieces[at + 1] = total, pieces[at] + len(c.encode("utf-8", "surrogatepass"))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each whole text."""
        if len(self.counts) > KEPT_SEGMENTS:
            self.clear()
        parts, starts = [], np.zeros(len(texts) + 1, dtype=np.int64)
        for i, text in enumerate(texts):
            if SPACE in text:  # the mark itself reads as a space
                text = text.replace(SPACE, " ")
            if not text:
                found = []
            elif "  " in text or text[0] == " " or text[-1] == " ":
                found = SEGMENT.findall(" " + text)
            else:
                found = text.split(" ")
            for s in set(found):
                if s not in self.index:
                    self.index[s] = len(self.counts)
                    self.counts.append(self.count_segment(s.replace(" ", SPACE) if s[:1] == " " else SPACE + s))
            parts.append(np.fromiter(map(self.index.__getitem__, found), dtype=np.int64, count=len(found)))
            starts[i + 1] = starts[i] + len(found)
        codes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        return sum_by_part(np.array(self.counts, dtype=np.int64)[codes] if len(codes) else codes, starts)


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One counter for each vocabulary file and Python worker."""
    if path not in _counters:
        _counters[path] = PieceCounter.from_file(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_bytes (UTF-8 bytes of the text).

    Null and empty texts have 0 tokens. Repeated rows and rows without id are counted each
    by itself; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = counter(vocabulary_path)
        for batch in batches:
            for begin, part in chunks_of(batch.column(1)):
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in part]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(part)), pa.array(by.count(part)), pa.array(sizes, type=pa.int64())], names=["id", "n_tokens", "n_bytes"]
                )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(frugal(run), "id long, n_tokens long, n_bytes long").withColumnRenamed("id", id_col)
