"""Helpers shared by the operators: scratch tables, checked broadcasts, word coding."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What mapInArrow takes.
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Characters that part words: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Rows that a table may have at most before it is joined by salting instead of broadcast.
BROADCAST_ROWS = 20_000
#: Parts into which a hot key of a salted join is dealt.
SALTS = 32


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tideline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = count()
        self._saved: list[tuple[str, str]] = []

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """The table as it is read again; by: a column that parts its files."""
        path = f"{self.root}/{next(self._n):02d}-{name.replace(' ', '-')}"
        self._saved.append((name, path))
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Deletes all tables but those of these names: nothing reads them any more."""
        gone = [path for name, path in self._saved if name not in names]
        self._saved = [x for x in self._saved if x[0] in names]
        self._delete(gone if names else [*gone, self.root])

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names, and hints Spark to delete shuffle files: it does so once the driver's plans are collected."""
        self._delete([path for name, path in self._saved if name in names])
        self._saved = [x for x in self._saved if x[0] not in names]
        self.spark._jvm.System.gc()

    def _delete(self, folders: list[str]) -> None:
        for folder in folders:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def content_hash(text: Column) -> Column:
    """Tells texts apart, with the id beside it; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def uniform_from_hash(*parts: Column) -> Column:
    """A number in (0, 1) fixed by the parts: 52 bits of their MD5, at the middle of their cell."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def small_join(df: DataFrame, small: DataFrame, key: str, salt_by: Column, rows: int | None = None) -> DataFrame:
    """Left join on a key of which one value may hold most rows.

    The small side is counted first. Up to BROADCAST_ROWS rows it is broadcast; beyond
    that it is copied once per salt and the large side is dealt over the salts, so a hot
    key is shared by SALTS tasks. Nulls of the key match nulls.
    """
    rows = small.count() if rows is None else rows
    right = small.withColumnRenamed(key, "__key")
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(right), df[key].eqNullSafe(right["__key"]), "left").drop("__key")
    left = df.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    right = right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = left[key].eqNullSafe(right["__key"]) & (left["__salt"] == right["__salt_r"])
    return left.join(right, on, "left").drop("__key", "__salt", "__salt_r")


def hot_join(left: DataFrame, right: DataFrame, key: str, size: str, most: int = BROADCAST_ROWS, total: int | None = None) -> DataFrame:
    """Inner join on a key of which few values may hold most of the left rows.

    right: one row for each key, with the number of left rows that have it in size. Keys with
    more than one in most of them number fewer than most, whatever the input, so these are
    broadcast and their left rows stay where they are; the others are joined by a shuffle.
    """
    total = left.count() if total is None else total
    hot = right.where(F.col(size) * most > total)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(size) * most <= total), key)
    return left.join(F.broadcast(hot), key).unionByName(cold).drop(size)


#: Bits of the largest filter of rows, and bits for each row below that.
ROW_FILTER_BITS = 27
BITS_A_ROW = 64


def key_filter(wanted: DataFrame, key: Column) -> Callable[..., DataFrame]:
    """A filter of rows by a hashed key: those whose key is among the wanted rows' keys pass, and a few others.

    What a join with wanted drops needn't be moved. The filter is a table of bits, up to 64 for
    each wanted row and at most 2 ** 27, put together by Spark in parts of 64 bits. It gives
    any row the same answer in all tables that it is used on.

    What comes back takes a table and its key, and perhaps without (a broadcast of keys in order
    that don't pass) and then with its schema: what the same Python worker makes of the batches
    that pass (the table's columns, and the key). A second mapInArrow in a task is a second
    worker, to which all texts are moved once more.
    """
    n = wanted.count()
    bits = max(12, min(ROW_FILTER_BITS, (max(1, n) * BITS_A_ROW).bit_length() - 1))
    slot = lambda name: F.pmod(F.col(name), F.lit(1 << bits))
    parts = wanted.select(key.alias("__key")).select(slot("__key").alias("s")).groupBy(F.shiftright("s", 6).alias("part"))
    made = parts.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))).alias("held")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[made.column(0).to_numpy()] = made.column(1).to_numpy().astype(np.int64).view(np.uint64)
    shared = wanted.sparkSession.sparkContext.broadcast(table)
    del made, table
    give_back()

    def passing(df: DataFrame, key: Column, without: Broadcast | None = None, then: Batches | None = None, schema: str | None = None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(batch.num_columns - 1).to_numpy()
                s = own & ((1 << bits) - 1)
                held = (shared.value[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                if without is not None and len(without.value):
                    apart = without.value
                    held &= apart[np.minimum(np.searchsorted(apart, own), len(apart) - 1)] != own
                if held.any():
                    yield batch.filter(pa.array(held))

        keyed = df.withColumn("__key", key)
        if then is not None:
            return keyed.mapInArrow(frugal(lambda batches: then(run(batches))), schema)
        return keyed.mapInArrow(frugal(run), keyed.schema).drop("__key")

    return passing


def likely_in(df: DataFrame, wanted: DataFrame, key: Column) -> DataFrame:
    """The rows of df whose key (a hash of columns that both have) is among the wanted rows' keys, and a few others."""
    return key_filter(wanted, key)(df, key)


#: Keys that pass a filter wrongly and are broadcast, at most.
KEYS_APART = 2_000_000


def wanted_rows(keys: DataFrame, wanted: DataFrame, scratch: Scratch) -> Callable[..., DataFrame]:
    """What picks the rows of a table whose 64-bit key is wanted. keys: key of all rows of the table; wanted: key, once each.

    The table isn't moved: the keys that a filter of the wanted ones lets pass wrongly are known
    beforehand, and few enough to broadcast. Were they many, the table would be joined. What
    comes back takes the table and its key, and perhaps columns to go on with, and then with its
    schema: what is made of the batches of these columns, by the worker that picks the rows.
    """
    wanted = scratch.save(wanted.select("key"), "wanted keys")
    passing = key_filter(wanted, F.col("key"))
    apart = scratch.save(passing(keys.select("key"), F.col("key")).distinct().join(wanted, "key", "left_anti"), "keys apart")
    few = apart.count() <= KEYS_APART
    without = wanted.sparkSession.sparkContext.broadcast(np.sort(apart.toArrow().column(0).to_numpy())) if few else None
    give_back()

    def picked(df: DataFrame, key: Column, columns: list[Column] | None = None, then: Batches | None = None, schema: str | None = None) -> DataFrame:
        rows = df.select(*(columns or df.columns), key.alias("key"))
        if few:
            found = passing(rows, F.col("key"), without, then, schema)
            return found if then is not None else found.drop("key")
        found = passing(rows, F.col("key")).join(wanted, "key", "left_semi").drop("key")
        return found if then is None else found.mapInArrow(frugal(then), schema)

    return picked


def rows_in(df: DataFrame, key: Column, keys: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of df whose 64-bit key is wanted. keys: key of all rows of df; wanted: key, once each."""
    return wanted_rows(keys, wanted, scratch)(df, key)


class WordCoder:
    """Numbers the words of texts; the same word keeps its number until the coder is cleared."""

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.words: list[bytes] = []

    def code(self, texts: list[str], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words, and where each text's codes start (one more entry at the end).

        table: what each byte of the UTF-8 text is read as.
        """
        index, words = self.index, self.words
        parts, starts = [], np.zeros(len(texts) + 1, dtype=np.int64)
        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass")
            found = (raw if table is None else raw.translate(table)).split()
            new = set(found).difference(index)
            index.update(zip(new, range(len(words), len(words) + len(new)), strict=True))
            words.extend(new)
            parts.append(np.fromiter(map(index.__getitem__, found), dtype=np.int64, count=len(found)))
            starts[i + 1] = starts[i] + len(found)
        return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), starts


def sum_by_part(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]], empty parts included."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """Mixes the bits of unsigned 64-bit numbers (finaliser of SplitMix64)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and then what it freed goes back to the system: workers wait for their next task, and would hold it meanwhile."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def text_chunks(texts: list[str], max_chars: int = 4_000_000):
    """Index ranges of consecutive texts of about max_chars together; a longer text stands alone."""
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > max_chars:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def chunks_of(column: pa.Array, max_bytes: int = 4_000_000):
    """(first row, texts) of a batch's texts, about max_bytes at a time, so that no batch is turned into Python strings whole; null is ''."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > max_bytes:
            yield begin, [t or "" for t in column.slice(begin, i - begin).to_pylist()]
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, [t or "" for t in column.slice(begin).to_pylist()]
