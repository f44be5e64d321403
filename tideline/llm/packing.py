"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are powers of two: as many of the
longest as fit, then the binary digits of the rest. Each piece is a sequence by itself, so
no sequence holds two documents and none is padded; sequences of one length form a bucket,
from which batches of one shape are drawn. Rows leave each task sorted by bucket, and within a
bucket in random order, so that pieces of one document don't follow each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCoder, chunks_of, frugal, sum_by_part

SEQUENCE_TOKENS = 2048
END_ID = 1
#: Words whose ids a Python worker keeps; then it starts anew, which costs time and nothing else.
KEPT_WORDS = 1 << 19
#: Words that a worker keeps beyond the end of a task, where the memory is for others.
IDLE_WORDS = 1 << 17

# The pre-tokens of the tokenizer file, and the names of its added tokens.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")  # and the ends of lines
ADDED = ("<|startoftext|>", "<|endoftext|>")
#: Words that normalisation does no more to than to lower their case.
PLAIN = regex.compile(r"[\x21-\x7E¡-ÿ]+")

PIECES = "doc_row long, doc_id long, start long, length long, doc_tokens long, ids binary"


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all parts in a row."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and never joins words over it.

    A text's ids are those of its words in a row. Each word is encoded once, in a batch
    with others: plain words are reduced to their pre-tokens, which many words share. The
    words that hold an added token, or characters that normalisation may change, go
    through the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.is_end[ends] = True
        self.coder = WordCoder(KEPT_WORDS)
        self.clear()

    def clear(self) -> None:
        self.coder.clear()
        self.pre: dict[str, int] = {}
        self.pre_ids, self.pre_at = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.ids, self.at = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def tokenized(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_pre_tokens(self, found: list[str]) -> None:
        """Numbers new pre-tokens and appends their ids to the table."""
        parts, ends = [self.pre_ids], [self.pre_at]
        for i in range(0, len(found), 5_000):
            part = found[i : i + 5_000]
            ids = self.tokenized([" ".join(part)])[0]
            end = np.flatnonzero(self.is_end[ids]) + 1
            if len(end) != len(part):  # a pre-token that the tokenizer splits by itself
                single = self.tokenized(part)
                ids, end = np.concatenate(single), np.cumsum([len(x) for x in single])
            parts.append(ids)
            ends.append(end + ends[-1][-1])
        self.pre.update(zip(found, range(len(self.pre), len(self.pre) + len(found)), strict=True))
        self.pre_ids, self.pre_at = np.concatenate(parts), np.concatenate(ends)

    def learn(self, words: list[bytes]) -> None:
        """Appends the ids of new words to the table."""
        texts = b"\n".join(words).decode("utf-8", "replace").split("\n")
        plain = [t.isascii() and t.isprintable() and "<|" not in t or not any(a in t for a in ADDED) and PLAIN.fullmatch(t) is not None for t in texts]
        # One search over all plain words, a line for each word; those that aren't plain leave theirs empty.
        found = PRE_TOKEN.findall("\n".join([t if p else "" for t, p in zip(texts, plain, strict=True)]).lower() + "\n")
        self.learn_pre_tokens([p for p in dict.fromkeys(found) if p not in self.pre and p != "\n"])
        codes = np.fromiter(map(self.pre.get, found, repeat(-1)), dtype=np.int64, count=len(found))
        n = np.diff(np.flatnonzero(codes < 0), prepend=-1) - 1
        codes = codes[codes >= 0]
        size = self.pre_at[codes + 1] - self.pre_at[codes]
        sizes = sum_by_part(size, np.concatenate([[0], np.cumsum(n)]))
        ids = gather(self.pre_ids, self.pre_at[codes], size)
        odd = [i for i, p in enumerate(plain) if not p]
        if odd:
            # Their ids go in where the words stand.
            whole = self.tokenized([texts[i] for i in odd])
            places = (np.cumsum(sizes) - sizes)[odd]
            ids = np.insert(ids, np.repeat(places, [len(w) for w in whole]), np.concatenate(whole))
            sizes[odd] = [len(w) for w in whole]
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids start (one more entry at the end)."""
        if len(self.coder.words) > KEPT_WORDS:
            self.clear()
        codes, starts = self.coder.code(texts)
        known = len(self.at) - 1
        if len(self.coder.words) > known:
            self.learn(self.coder.words[known:])
        sizes = self.at[codes + 1] - self.at[codes]
        ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(sizes)])
        return gather(self.ids, self.at[codes], sizes), ends[starts]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def binary_lengths(tokens: int, longest: int = SEQUENCE_TOKENS) -> list[int]:
    """Lengths of the pieces, longest first: powers of two that add up to tokens."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, longest: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_row, doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), bucket, sequence_id, offset.

    longest is a power of two. A null or empty text is packed as its end id alone, so each
    row gives a piece at least; repeated rows and rows without id are packed like others,
    each by itself, and doc_row tells them apart: it is unique to the input's row. sequence_id
    is unique; other columns of the input are ignored.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest has to be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(tokenizer_path)
        for batch in batches:
            for begin, texts in chunks_of(batch.column(2), 2_000_000):
                docs_of, ids = (batch.column(c).slice(begin, len(texts)).to_pylist() for c in (0, 1))
                tokens, starts = by.encode(texts)
                rows: list[tuple] = []
                for k in range(len(texts)):
                    own = np.append(tokens[starts[k] : starts[k + 1]], np.uint32(END_ID)).astype("<u4")
                    at = 0
                    for n in binary_lengths(len(own), longest):
                        rows.append((docs_of[k], ids[k], at, n, len(own), own[at : at + n].tobytes()))
                        at += n
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.binary()], strict=True)],
                    names=["doc_row", "doc_id", "start", "length", "doc_tokens", "ids"],
                )
        if len(by.coder.words) > IDLE_WORDS:
            by.clear()

    pieces = docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(frugal(cut), PIECES)
    pieces = pieces.withColumn("bucket", F.log2(F.col("length")).cast("int")).sortWithinPartitions(F.desc("length"), F.xxhash64("doc_row", "start"))
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
