"""Near duplicates: a Jaccard self-join on sets of word n-grams by MinHash banding.

Rows with the same n-gram set form one class before anything is joined, so exact copies
cost nothing. The sets' signatures are cut into bands; the number of bands and rows is
chosen for a target recall at the threshold (bands_for). Sets that agree on a band meet in
a bucket, and pairs are verified on the full sets:

1. every set of a bucket against the bucket's hub, the set that meets the most others: linear
   in the bucket, and mostly enough to connect a group of near copies, whatever its size;
2. connected components of the links found;
3. under hubs that still hold several components, the pairs across components that can reach
   the threshold: those that share enough n-grams which the hub lacks (found by prefixes of
   these n-grams, with hubs of their own first), or come close enough by the hub's alone.
   What these leave open is compared bucket by bucket, in blocks, so nothing that banding
   proposes stays undecided, and no pair without a link becomes a row;
4. inside a component all pairs are counted by block products of membership matrices over what
   tells its sets from one of them, which gives each document its number of links without a row
   per pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordCoder, chunks_of, content_hash, frugal, hot_join, key_filter, likely_in, mix64

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
#: Sets in a block of steps 3 and 4.
BLOCK = 256
#: Sets of small components or buckets that one group takes, about.
GROUP_SETS = 512
#: Hubs whose n-grams are broadcast, at most: those with more than one in so many of all pairs.
HOT_HUBS = 64
SEED = 20_240
#: Values of a sketch, and how many deviations below the threshold its estimate may lie.
SKETCH, DEVIATIONS = 128, 4.5
#: Pairs for each set of a block that go on as rows; a block with more is compared on its full sets.
PAIRS_A_SET = 4
#: Sets made from several texts whose ids are broadcast, at most.
REPEATED_SETS = 200_000
#: For comparisons of sizes with products of the threshold.
EPSILON = 1e-9

#: Of UTF-8: A-Z lowered.
LOWER_ASCII = bytes(range(256)).lower()

_MUL = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) whose recall at the threshold is met within max_hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band count within max_hashes reaches the recall")
    return best


def shingle_sets(texts: list[str], words: int = WORDS, ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams, and where each text's hashes start.

    Words are parted by ASCII white space and lowercased (ascii_only: A-Z alone). A text of
    fewer words than an n-gram has, but at least one, gives one n-gram of all its words.
    """
    coder = WordCoder()
    codes, starts = coder.code(texts, LOWER_ASCII) if ascii_only else coder.code([t.lower() for t in texts])
    by_word = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coder.words), dtype=np.uint64, count=len(coder.words))
    h = by_word[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
    sets: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        n = max(0, len(h) - words + 1)
        grams = np.zeros(n, dtype=np.uint64)
        for k in range(words):
            grams = grams * _MUL + h[k : k + n]
        grams = mix64(grams)
        for begin, end in zip(starts[:-1], starts[1:], strict=True):
            if end - begin >= words:
                sets.append(np.unique(grams[begin : end - words + 1]))
            elif end > begin:
                one = np.uint64(end - begin)
                for x in h[begin:end]:
                    one = one * _MUL + x
                sets.append(mix64(np.array([one], dtype=np.uint64)))
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
    ends = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), ends


def set_key(hashes: np.ndarray) -> bytes | None:
    """16 bytes that stand for a set; none for the empty set."""
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def band_hashes(hashes: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row per non-empty set, one column per band: 64-bit hashes of the band's minima."""
    starts = ends[:-1][np.diff(ends) > 0]
    made = np.random.default_rng(SEED).integers(0, 1 << 63, size=(bands * rows, 2), dtype=np.uint64)
    out = np.zeros((len(starts), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            band = np.full(len(starts), mix64(np.array([b + 1], dtype=np.uint64))[0])
            for r in range(rows):
                xor, times = made[b * rows + r]
                least = np.minimum.reduceat((hashes ^ xor) * (times * np.uint64(2) + np.uint64(1)), starts)
                band = mix64(band * _MUL + least)
            out[:, b] = band
    return out


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, content: null texts are empty ones. Rows that repeat an id, or have none, are told apart by their contents."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("content", content_hash(F.col("text")))


def signatures(docs: DataFrame, bands: int, rows: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, content (hash of the text), set_id (null without words), n (its n-grams), bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks_of(batch.column(2), 2_000_000):
                hashes, ends = shingle_sets(texts, words)
                keys = [set_key(hashes[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                sizes = np.diff(ends)
                made = iter(band_hashes(hashes, ends, bands, rows).astype(np.int64) if len(hashes) else ())
                values = [next(made) if n else None for n in sizes]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(begin, len(texts)) for i in (0, 1)), pa.array(keys, type=pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(values, type=pa.list_(pa.int64()))],
                    names=["id", "content", "set_id", "n", "bands"],
                )

    rows_in = rows_of(docs, id_col, text_col).select("id", "content", "text")
    return rows_in.mapInArrow(frugal(sign), "id long, content long, set_id binary, n int, bands array<long>")


def sketch(hashes: np.ndarray) -> bytes:
    """SKETCH bytes: of each range of hashes the smallest one of the set, as a number from 1 to 255; 0 where it has none.

    Two sets agree in a range that one of them has as often as their similarity says.
    """
    ranges = (hashes >> np.uint64(64 - (SKETCH - 1).bit_length())).astype(np.int64)
    found, first = np.unique(ranges, return_index=True)
    out = np.zeros(SKETCH, dtype=np.uint8)
    out[found] = mix64(hashes[first]) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def full_sets(docs: DataFrame, signed: DataFrame, wanted: DataFrame, scratch: Scratch, words: int, id_col: str, text_col: str, ascii_only: bool = False) -> DataFrame:
    """set_id, grams, sketch of the wanted (id, content, set_id), one row for each set, and of a few others: the n-gram sets, read from the texts again.

    Neither texts nor sets are moved: a filter of the wanted rows says which texts are read, and
    the same filter over the signed rows (id, content, set_id) which sets are made from several
    texts. Only of these one is picked by a shuffle.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks_of(batch.column(0), 2_000_000):
                hashes, ends = shingle_sets(texts, words, ascii_only)
                sets = [hashes[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(s) for s in sets], type=pa.binary()), pa.array([s.astype(np.int64) for s in sets], type=pa.list_(pa.int64())), pa.array([sketch(s) for s in sets], type=pa.binary())],
                    names=["set_id", "grams", "sketch"],
                )

    row = F.xxhash64(F.coalesce("id", F.lit(-1).cast("long")), "content")
    passing = key_filter(wanted, row)
    texts = rows_of(docs, id_col, text_col).select("text", row.alias("row"))
    found = passing(texts, F.col("row"), then=make, schema="set_id binary, grams array<long>, sketch binary")
    several = passing(signed.where("set_id is not null").select("id", "content", "set_id"), row).groupBy("set_id").agg(F.count(F.lit(1)).alias("texts"))
    several = scratch.save(several.where("texts > 1").select("set_id", F.lit(True).alias("again")), "several texts")
    if several.count() <= REPEATED_SETS:
        found = found.join(F.broadcast(several), "set_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    else:
        found = found.withColumn("again", F.lit(True))
    found = scratch.save(found, "made", "again")
    one = scratch.save(found.where("again").drop("again").dropDuplicates(["set_id"]), "one of several")
    return found.where("not again").drop("again").unionByName(one)


def with_grams(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) with the n-gram sets of both: ga, gb."""
    left = sets.select(F.col("set_id").alias("a"), F.col("grams").alias("ga"))
    hubs = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("pairs")).join(sets.select(F.col("set_id").alias("b"), F.col("grams").alias("gb")), "b")
    return hot_join(pairs.join(left, "a"), hubs, "b", "pairs", HOT_HUBS, pairs.count())


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, common, similarity, beside: the sizes, common n-grams and exact Jaccard similarity of each pair, and what a has beside b."""
    both = with_grams(pairs.select("a", "b"), sets).withColumn("beside", F.array_except("ga", "gb"))
    both = both.select("a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), (F.size("ga") - F.size("beside")).alias("common"), "beside")
    return both.withColumn("similarity", F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))


def components(links: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """set_id, comp: the smallest set of each connected component, for sets with links.

    Each round takes the smallest label around and then the label's own label, so the
    number of rounds grows with the logarithm of a component's diameter.
    """
    edges = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("set_id")).agg(F.least(F.min("a"), F.min("b")).alias("comp"))
    labels = scratch.save(labels, "labels")
    for _ in range(most):
        around = edges.join(labels, edges["b"] == labels["set_id"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(around, labels["set_id"] == around["a"]).select("set_id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("set_id").alias("comp"), F.col("comp").alias("above"))
        step = step.join(up, "comp").select("set_id", "was", F.least("comp", "above").alias("comp"))
        step = scratch.save(step, "labels")
        changed = step.where("comp <> was").limit(1).count()
        labels = step.select("set_id", "comp")
        if not changed:
            return labels
    raise RuntimeError(f"components not final after {most} rounds")


def common_counts(grams: pd.Series) -> np.ndarray:
    """How many elements all pairs of a block of sets have in common, by products of membership matrices."""
    lengths = np.array([len(g) for g in grams])
    if not lengths.sum():
        return np.zeros((len(grams), len(grams)))
    flat = np.concatenate([np.asarray(g, dtype=np.int64) for g in grams])
    owner = np.repeat(np.arange(len(grams)), lengths)
    distinct, column = np.unique(flat, return_inverse=True)
    shared = np.bincount(column, minlength=len(distinct)) > 1
    order = np.argsort(column, kind="stable")
    order = order[shared[column[order]]]
    column, owner = column[order], owner[order]
    common = np.zeros((len(grams), len(grams)), dtype=np.float64)
    width = 4096
    for low in range(0, len(distinct), width):
        i, j = np.searchsorted(column, [low, low + width])
        if i < j:
            block = np.zeros((len(grams), width), dtype=np.float32)
            block[owner[i:j], column[i:j] - low] = 1
            common += block @ block.T
    return common


def jaccard(common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return common / (sizes[:, None] + sizes[None, :] - common)


def count_block_links(members: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the sets of two blocks, or within one: set_id and the documents it is linked to there.

    Of sets x and y with what tells them from their component's base, |x & y| is the base less
    what x lacks of it and what y lacks, plus what their differences have in common.
    """
    found = []
    for _, part in members.groupby("comp", sort=False):
        copies, lacks = part["copies"].to_numpy(), part["lacks"].to_numpy()
        common = part["base_n"].to_numpy()[0] - lacks[:, None] - lacks[None, :] + common_counts(part["unlike"])
        linked = jaccard(common, part["n"].to_numpy()) >= threshold
        np.fill_diagonal(linked, False)
        side = part["block"].to_numpy()
        if (side != side[0]).any():
            linked &= side[:, None] != side[None, :]
        found.append(pd.DataFrame({"set_id": part["set_id"].to_numpy(), "linked": (linked * copies[None, :]).sum(axis=1)}))
    return pd.concat(found, ignore_index=True)


def block_bridges(members: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """a, b: of each two components with links between the block's sets, one link."""
    found = []
    for _, part in members.groupby("bucket", sort=False):
        ids, (comp, _) = part["set_id"].to_numpy(), pd.factorize(part["comp"])
        alike = jaccard(common_counts(part["grams"]), part["grams"].map(len).to_numpy()) >= threshold
        i, j = np.nonzero(np.triu(alike & (comp[:, None] != comp[None, :])))
        pair = np.minimum(comp[i], comp[j]) * len(part) + np.maximum(comp[i], comp[j])
        _, first = np.unique(pair, return_index=True)
        found.append(pd.DataFrame({"a": ids[i[first]], "b": ids[j[first]]}))
    return pd.concat(found, ignore_index=True)


def in_blocks(rows: DataFrame, group: str) -> DataFrame:
    """rows with shard and block: a shard has two blocks of a large group, or some small groups whole. rows: set_id, group, of (its sets)."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("of") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    small = max(1, rows.count() // GROUP_SETS)
    shard = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(group), F.lit(small))).otherwise(F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other")))
    return dealt.withColumn("shard", shard).drop("blocks", "other", "of")


def close_by_sketch(sketches: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets may reach the threshold: all that do, but for a chance of DEVIATIONS."""
    out = np.zeros((len(sketches), len(sketches)), dtype=bool)
    for i, one in enumerate(sketches):
        same = ((sketches == one) & (one != 0)).sum(axis=1)
        held = ((sketches != 0) | (one != 0)).sum(axis=1)
        out[i] = same >= threshold * held - DEVIATIONS * np.sqrt(held * threshold * (1 - threshold)) - EPSILON
    return out


def may_reach(parts: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (i, j) of sets may reach the threshold by 16 bits of each n-gram: all that do, and few others.

    Of x no more n-grams can be in y than have bits that y has, and the same the other way round.
    """
    held = np.zeros((len(parts), 1 << 16), dtype=bool)
    for k, bits in enumerate(parts):
        held[k, bits] = True
    out = np.zeros(len(i), dtype=bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        common = min(np.count_nonzero(held[y, parts[x]]), np.count_nonzero(held[x, parts[y]]))
        out[k] = common >= threshold * (len(parts[x]) + len(parts[y]) - common) - EPSILON
    return out


def pairs_by_sketch(members: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """a, b: pairs across components that may be linked; of a block with too many of them bucket, comp and shard of its sets instead, as rows without b."""
    found = []
    for bucket, part in members.groupby("bucket", sort=False):
        ids, comp = part["set_id"].to_numpy(), pd.factorize(part["comp"])[0]
        values = np.frombuffer(b"".join(part["sketch"]), dtype=np.uint8).reshape(len(part), SKETCH)
        i, j = np.nonzero(np.triu(close_by_sketch(values, threshold) & (comp[:, None] != comp[None, :])))
        if len(i):
            bits = [np.asarray(x).astype(np.int64) & 0xFFFF for x in part["bits"]]
            near = may_reach(bits, i, j, threshold)
            i, j = i[near], j[near]
        if len(i) > PAIRS_A_SET * len(part):
            found.append(pd.DataFrame({"a": ids, "b": None, "bucket": bucket, "comp": part["comp"].to_numpy(), "shard": part["shard"].to_numpy()}))
        else:
            found.append(pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "bucket": bucket, "comp": None, "shard": None}))
    return pd.concat(found, ignore_index=True)


def links_inside(members: DataFrame, sets: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """set_id, linked: documents of other sets of its component within the threshold. members: set_id, comp, copies, n, of (sets in the component).

    Sets are compared by their differences from the component's base, its set with the most
    links, so near copies are sent around as the few n-grams in which they differ.
    """
    run = lambda part: count_block_links(part, threshold)
    degree = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("degree"))
    bases = members.select("set_id", "comp").join(degree, "set_id").groupBy("comp").agg(F.max(F.struct("degree", "set_id"))["set_id"].alias("base"), F.count(F.lit(1)).alias("held"))
    bases = bases.join(sets.select(F.col("set_id").alias("base"), F.col("grams").alias("base_grams")), "base").drop("base")
    own = hot_join(members.join(sets.select("set_id", "grams"), "set_id"), bases, "comp", "held", HOT_HUBS, members.count())
    lacks = F.array_except("base_grams", "grams")
    own = own.select("set_id", "comp", "copies", "n", "of", F.size("base_grams").alias("base_n"), F.size(lacks).alias("lacks"), F.concat(lacks, F.array_except("grams", "base_grams")).alias("unlike"))
    counted = in_blocks(own, "comp").groupBy("shard").applyInPandas(run, "set_id binary, linked long")
    return counted.groupBy("set_id").agg(F.sum("linked").alias("linked"))


def bridges(state: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """a, b: links between components whose sets meet in a bucket. state: bucket, set_id, comp, of (sets in the bucket).

    Blocks are compared by sketches first, and what these leave by 16 bits of each n-gram, a
    quarter of the sets. The pairs that remain are few for each set and are verified; in a block
    where they aren't, the full sets are compared without a row for each pair.
    """
    near = lambda part: pairs_by_sketch(part, threshold)
    bits = F.transform("grams", lambda x: (x.bitwiseAND(F.lit(0xFFFF)) - F.lit(1 << 15)).cast("short")).alias("bits")
    blocks = in_blocks(state.join(sets.select("set_id", "sketch", bits), "set_id"), "bucket").select("shard", "bucket", "set_id", "comp", "sketch", "bits")
    found = scratch.save(blocks.groupBy("shard").applyInPandas(near, "a binary, b binary, bucket long, comp binary, shard long"), "close pairs")
    few = found.where("b is not null").select("a", "b").distinct()
    links = verified(few, sets).where(F.col("similarity") >= threshold).select("a", "b")
    run = lambda part: block_bridges(part, threshold)
    dense = found.where("b is null").select("shard", "bucket", F.col("a").alias("set_id"), "comp").join(sets.select("set_id", "grams"), "set_id")
    return links.unionByName(dense.groupBy("shard").applyInPandas(run, "a binary, b binary")).distinct()


def with_hubs(met: DataFrame) -> DataFrame:
    """bucket, set_id, n, hub: in each bucket the set that meets the most sets over all its buckets.

    Near copies agree with their common original more often than with each other, so the
    original, or a copy close to it, becomes the hub of most buckets of its group.
    """
    degree = met.groupBy("set_id").agg(F.sum("members").alias("degree"))
    hubs = met.join(degree, "set_id").groupBy("bucket").agg(F.max(F.struct("degree", "set_id")).alias("top"), F.count(F.lit(1)).alias("held"))
    return hot_join(met, hubs.select("bucket", F.col("top.set_id").alias("hub"), "held"), "bucket", "held").select("bucket", "set_id", "n", "hub")


def fits(x, y, threshold: float):
    """Whether sets of these sizes can reach the threshold."""
    return F.least(x, y) >= F.lit(threshold - EPSILON) * F.greatest(x, y)


def labelled(rows: DataFrame, comps: DataFrame, key: str, name: str = "comp") -> DataFrame:
    """Adds the component of the set in key: the set itself where it has no links."""
    known = comps.select(F.col("set_id").alias(key), F.col("comp").alias("__comp"))
    return rows.join(known, key, "left").withColumn(name, F.coalesce("__comp", key)).drop("__comp")


def open_hubs(tested: DataFrame, comps: DataFrame) -> DataFrame:
    """The tested (set a, hub b) of hubs that still hold several components, with the component of a."""
    rows = labelled(labelled(tested, comps, "a"), comps, "b", "hub_comp")
    mixed = rows.groupBy("b").agg(F.min(F.least("comp", "hub_comp")).alias("c0"), F.max(F.greatest("comp", "hub_comp")).alias("c1"))
    return rows.drop("hub_comp").join(mixed.where("c0 <> c1").select("b"), "b")


def pairs_within_hub(opened: DataFrame, threshold: float) -> DataFrame:
    """Pairs across components that could reach the threshold by n-grams of their hub alone.

    x and y need t / (1 + t) * (|x| + |y|) common n-grams. If x isn't linked to hub h, its
    n-grams in h suffice only for a y that is smaller than h; few sets come that close.
    """
    share = threshold / (1 + threshold)
    most = F.floor(F.col("common") / share - F.col("na") + EPSILON)
    least = opened.groupBy("b").agg(F.min("na").alias("least"))
    x = opened.where(F.col("similarity") < threshold).withColumn("most", most).where((F.col("most") < F.col("nb")) & (F.col("most") >= F.col("na") * (threshold - EPSILON)))
    x = x.join(least, "b").where("most >= least").select("b", F.col("a").alias("xa"), F.col("na").alias("xn"), "most", F.col("comp").alias("xc"))
    y = opened.where("na < nb").select("b", F.col("a").alias("ya"), F.col("na").alias("yn"), F.col("common").alias("yo"), F.col("comp").alias("yc"))
    both = x.join(y, "b").where((F.col("xc") != F.col("yc")) & (F.col("yn") <= F.col("most")) & fits(F.col("xn"), F.col("yn"), threshold))
    both = both.where(F.col("yo") >= F.lit(share) * (F.col("xn") + F.col("yn")) - EPSILON)
    return both.select(F.least("xa", "ya").alias("a"), F.greatest("xa", "ya").alias("b")).distinct()


def beside_hub(opened: DataFrame, tested: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """bucket, set_id, n, members, comp: buckets of sets that share an n-gram which their hub lacks.

    All other linked pairs share at least c = t * |x| - |x & h| such n-grams, so in any fixed
    order one of the first |x - h| - c + 1 of them: no more than that prefix is indexed. Rare
    n-grams come first, so a passage that many texts share brings together only those that
    have little else. Those of one row come before all others and bring nothing together, so
    they are only counted. Of buckets that hold the same sets one stands for all.
    """
    need = F.ceil(F.col("na") * (threshold - EPSILON))
    prefix = F.when(need - F.col("common") > 1, F.col("na") - need + 1).otherwise(F.col("na") - F.col("common"))
    rows = tested.select("a", "b", "beside").join(opened.select("a", "b", "na", "common", "comp"), ["a", "b"])
    rows = rows.select("a", "b", "na", "comp", prefix.cast("int").alias("prefix"), F.size("beside").alias("of"), F.explode("beside").alias("gram"))
    rows = scratch.save(rows, "rest")
    often = scratch.save(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("often")).where("often > 1").withColumn("held", F.col("often")), "often")
    rows = scratch.save(likely_in(rows, often, F.col("gram")), "shared rest")
    own = Window.partitionBy("a", "b")
    rank = F.row_number().over(own.orderBy("often", "gram"))
    alone = F.col("of") - F.count(F.lit(1)).over(own)
    rows = hot_join(rows, often, "gram", "held").withColumns({"rank": rank, "alone": alone}).where("alone + rank <= prefix")
    rows = rows.select(F.xxhash64("b", "gram").alias("bucket"), F.col("a").alias("set_id"), F.col("na").alias("n"), "comp")
    rows = scratch.save(rows, "prefixes")
    same = [F.bit_xor(F.xxhash64("set_id", F.lit(k))).alias(f"sets{k}") for k in (1, 2)]
    mixed = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), *same).where("c0 <> c1")
    mixed = mixed.groupBy("sets1", "sets2", "members").agg(F.min("bucket").alias("bucket"))
    return rows.join(mixed.select("bucket", "members"), "bucket")


def linked_sets(placed: DataFrame, sizes: DataFrame, make_grams: Callable[[DataFrame], DataFrame], threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """set_id, comp of all sets with links, set_id, grams, and the links found (a, b): steps 1 to 3 over any buckets of candidates.

    placed: set_id, n, bucket. sizes: set_id, n. make_grams: set_id, grams, sketch, once for each wanted set_id.
    """
    crowded = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").withColumn("held", F.col("members"))
    crowded = scratch.save(crowded, "crowded")
    placed = scratch.save(likely_in(placed, crowded, F.col("bucket")), "placed")
    scratch.drop("buckets of sets")
    met = scratch.save(hot_join(placed, crowded, "bucket", "held"), "meetings")
    shared = scratch.save(with_hubs(met), "buckets")
    scratch.drop("crowded", "placed", "meetings")
    grams = make_grams(shared.select("set_id").distinct())

    to_hub = scratch.save(shared.where("set_id <> hub").select(F.col("set_id").alias("a"), F.col("hub").alias("b")).distinct(), "to-hub")
    tested = scratch.save(verified(to_hub, grams), "hub-pairs")
    links = tested.where(F.col("similarity") >= threshold).select("a", "b")
    scratch.drop("wanted", "buckets", "to-hub")
    comps = components(links, scratch)

    opened = scratch.save(open_hubs(tested.drop("beside"), comps), "open")
    other = scratch.save(beside_hub(opened, tested, threshold, scratch), "beside")
    scratch.drop("rest", "often", "shared rest", "prefixes")
    second = labelled(with_hubs(other).select(F.col("set_id").alias("a"), "n", F.col("hub").alias("b")).where("a <> b").distinct(), comps, "a", "ca")
    second = labelled(second, comps, "b", "cb").where("ca <> cb").join(sizes.select(F.col("set_id").alias("b"), F.col("n").alias("nb")), "b")
    second = second.where(fits(F.col("n"), F.col("nb"), threshold))
    second = scratch.save(second.select("a", "b").union(pairs_within_hub(opened, threshold)).distinct(), "second")
    more = scratch.save(verified(second, grams).where(F.col("similarity") >= threshold).select("a", "b"), "second-pairs")
    if more.limit(1).count():
        links = links.union(more)
        comps = components(links, scratch)

    # What these hubs leave open is compared in blocks.
    scratch.drop("second", "open")
    state = labelled(other.select("bucket", "set_id"), comps, "set_id")
    mixed = state.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("of")).where("c0 <> c1").select("bucket", "of", F.col("of").alias("held"))
    state = scratch.save(hot_join(state, mixed, "bucket", "held"), "left-open")
    more = scratch.save(bridges(state, grams, threshold, scratch), "last-pairs")
    if more.limit(1).count():
        links = links.union(more)
        comps = components(links, scratch)
    return comps, grams, links


def classified(docs: DataFrame, threshold: float, words: int, recall: float, id_col: str, text_col: str, count: bool = True) -> DataFrame:
    """id, content, class_id, n_links (null unless they are to be counted), n, rep_id, first: of each row; first: whether (id, content) is the first of its class."""
    scratch = Scratch(docs.sparkSession, "ngram-jaccard")
    bands, rows = bands_for(threshold, recall)
    signed = scratch.save(signatures(docs, bands, rows, words, id_col, text_col), "signatures and bands")
    of_set = signed.where("set_id is not null").groupBy("set_id")
    first = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "content"))
    banded = of_set.agg(first.alias("own"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    banded = scratch.save(banded.withColumn("rep_id", F.col("own.id")), "buckets of sets")
    # What is needed to the end is little without the bands.
    signed, reps = scratch.save(signed.drop("bands"), "signatures"), scratch.save(banded.drop("bands"), "sets")
    scratch.drop("signatures and bands")

    placed = banded.select("set_id", "n", F.explode("bands").alias("bucket"))
    owners = reps.select("set_id", "own.id", "own.content")
    make = lambda wanted: full_sets(docs, signed, scratch.save(wanted.join(owners, "set_id"), "wanted"), scratch, words, id_col, text_col)
    comps, grams, links = linked_sets(placed, reps.select("set_id", "n"), make, threshold, scratch)

    members = reps.select("set_id", "own", "copies", "n").join(comps, "set_id")
    whole = members.groupBy("comp").agg(F.min("own").alias("top"), F.count(F.lit(1)).alias("of"))
    members = scratch.save(members.drop("own").join(whole, "comp"), "members")
    known = members.select("set_id", "top")
    known = known.join(links_inside(members.drop("top"), grams, links, threshold), "set_id", "left") if count else known.withColumn("linked", F.lit(None).cast("long"))
    facts = reps.select("set_id", "rep_id", "own", "copies").join(known, "set_id", "left")
    facts = facts.select("set_id", "rep_id", F.coalesce("top", "own").alias("top"), "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1 if count else F.col("linked")).alias("n_links"))
    facts = scratch.save(facts, "facts")
    scratch.keep("signatures", "facts")

    some = hot_join(signed.where("set_id is not null").select("id", "content", "set_id", "n"), facts, "set_id", "copies")
    is_first = F.col("id").eqNullSafe(F.col("top.id")) & (F.col("content") == F.col("top.content"))
    some = some.select("id", "content", F.col("top.id").alias("class_id"), "n_links", "n", "rep_id", is_first.alias("first"))
    none = signed.where("set_id is null").select("id", "content", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n", F.col("id").alias("rep_id"), F.lit(True).alias("first"))
    return some.unionByName(none)


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, class_id (smallest id of its component), n_links, set_size, rep_id (smallest id with the same set).

    n_links counts the other documents whose similarity reaches the threshold, equal ones
    included. Null and empty texts have no n-grams: a class of their own each, without
    links. Repeated rows are copies of each other. Rows without id take part; a class in
    which no row has an id has none either. Other columns are ignored.
    """
    found = classified(docs, threshold, words, recall, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "class_id", "n_links", F.col("n").cast("long").alias("set_size"), "rep_id")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that with the smallest id (without ids: the smallest hash), with all its columns.

    Rows are told apart by id and text, so rows with one id and different texts are judged each
    by itself; rows that repeat both stay together.
    """
    found = classified(docs, threshold, WORDS, RECALL, id_col, text_col, count=False)
    gone = found.where(~F.col("first")).select(F.col("id").alias("__id"), F.col("content").alias("__content")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (content_hash(docs[text_col]) == gone["__content"]), "left_anti")
