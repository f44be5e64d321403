"""Main text of web pages: markup first, then a suffix array over each host's pages.

A page is read into blocks in page order. Markup settles most of them: what stands in menus,
headers, footers, forms and the like is dropped, what stands in an article (or else in the
main part) is kept. All other blocks are open, whether they stand beside an article or on a
page without one, and whether or not they are links; they are judged by their host's suffix
array:

1. the token streams of the host's pages, concatenated, have a suffix at every token. Suffixes
   are compared by up to LONG tokens, within their block; a block of fewer than DEPTH tokens
   is compared whole. A repeated substring of n >= DEPTH tokens is covered by its windows of
   DEPTH, which are repeated too, so deeper comparison would cover no token more;
2. suffixes are sorted by host and tokens (of equal ones one stands, with what tells its pages
   apart, so a menu on all pages is one row), dealt into sorted ranges: a host with a third of
   all pages is spread over tasks. Tokens are ordered by their hashes, which is an order as any;
3. neighbours with DEPTH, or LONG, common tokens form runs of the array. A run on two distinct
   pages, of different addresses and contents, is a repeated substring; a run that an end of a
   batch cuts is put together from its parts. An open block that substrings of DEPTH tokens
   cover whole is boilerplate; from other open blocks runs of LONG repeated tokens are cut, and
   the unique runs stay.

Articles are never judged by repetition, since copies of an article are articles.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks_of, frugal, mix64, small_join

#: Tokens of a suffix that are compared: to judge whole blocks, and to cut runs inside them.
DEPTH = 5
LONG = 12
#: Slots of the filter through which pages are searched for the beginnings that open blocks have, at most, and for each of these.
FILTER_BITS = 27
SLOTS_A_ROW = 64
#: Suffixes that a task writes out at once.
SLICE = 1 << 16
#: Words whose numbers a worker remembers.
WORDS_HELD = 1 << 17
SEED = 977

# HTML elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
# Left out whole as well, but without an end tag they hold nothing.
SKIPPED = frozenset("noscript template svg math object audio video canvas".split())
CHROME = frozenset("head nav footer aside form dialog menu button select label".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted recommended related reply replies"
    " respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar".split()
)
# Elements that hold blocks: inside an article only these are chrome by their class, and only by a whole word of it.
HOLDERS = frozenset("article aside details div dl fieldset figure footer header main nav ol section table ul".split())
OUTER_WORDS = frozenset(["header", "top", "topbar", "bottom", "widget", "widgets"])
# Lists that are menus if they hold several items and all of these are links.
LISTS = frozenset(["ul", "dl", "dir"])
NEGATING = frozenset(["no", "has", "with", "without", "not"])
# Names of advertising slots (ad-slot, adUnit), which no text bears: chrome on elements of any kind.
AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored".split())
SLOT_WORDS = frozenset("banner box container frame placeholder slot slots unit units wrapper".split())
KIND_WORDS = frozenset(["article", "post", "entry", "story", "blog"])
BODY_WORDS = frozenset(["content", "body", "text", "main"])

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>"
    r"|<[!?/a-zA-Z][^<>]*>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[\s_]+|(?<=[a-z])(?=[A-Z])")
NAME_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")

DROPPED, OPEN, MAIN, ARTICLE = range(4)


def names_ad_slot(names: str) -> bool:
    """Whether one of the class names is made of words for advertising and for a slot, and of nothing else."""
    found = [{w.lower() for w in NAME_PARTS.split(name) if w and not w.isdigit()} for name in names.split()]
    return any(w & AD_WORDS and w & SLOT_WORDS and w <= AD_WORDS | SLOT_WORDS for w in found)


def attribute_role(tag: str, attributes: str, inside: bool) -> int | None:
    """What an element's attributes say about its content; None where they say nothing."""
    found: int | None = None
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return DROPPED
        if name == "role":
            if value.lower() in CHROME_ROLES:
                return DROPPED
            found = max(found or 0, MAIN) if value.lower() == "main" else found
        elif name == "itemprop" and value.lower() == "articlebody":
            found = ARTICLE
        elif name in ("class", "id") and tag not in ("html", "body"):
            if names_ad_slot(value):
                return DROPPED
            for token in PARTS.split(value):
                words = {w for w in token.lower().split("-") if w}
                if words & NEGATING:
                    continue
                if (tag in HOLDERS and token.lower() in CHROME_WORDS) if inside else words & (CHROME_WORDS | OUTER_WORDS):
                    return DROPPED
                if words & KIND_WORDS and words & BODY_WORDS or words == {"main"} or words == {"content"} and name == "id":
                    found = max(found or 0, ARTICLE if words & KIND_WORDS else MAIN)
    return found


def read_blocks(html: str) -> list[tuple[int, bool, str]]:
    """(role, whole block inside links, text) of all blocks with text, in page order.

    An open list of several items, all of them links, is a menu and dropped.
    """
    blocks: list[tuple[int, bool, str]] = []
    lists: list[int] = []  # of the open lists: the blocks before each
    menus: list[tuple[int, int]] = []
    last = [-1]  # the last block that no menu may hold
    stack: list[tuple[str, int | None]] = []
    opened: dict[str, int] = {}
    depth = [0, 0, 0, 0]  # of the open elements that give each role
    piece: list[str] = []
    state = [OPEN, True]  # role of the block being read, and whether it is all links

    def flush() -> None:
        text = " ".join("".join(piece).split())
        if text:
            if state[0] != DROPPED and not (state[0] == OPEN and state[1]):
                last[0] = len(blocks)
            blocks.append((state[0], state[1], text))
        piece.clear()
        state[1] = True

    def role() -> int:
        return DROPPED if depth[DROPPED] else ARTICLE if depth[ARTICLE] else MAIN if depth[MAIN] else OPEN

    def add(raw: str) -> None:
        text = html_lib.unescape(raw) if "&" in raw else raw
        now = role()
        if not text.strip():
            if piece:
                piece.append(text)
            return
        if piece and now != state[0]:
            if now == DROPPED:  # a dropped part inside a block doesn't part it
                blocks.append((DROPPED, False, " ".join(text.split())))
                piece.append(" ")
                return
            flush()
        state[0] = now
        state[1] = state[1] and opened.get("a", 0) > 0
        piece.append(text)

    def close(tag: str) -> None:
        while stack:
            t, r = stack.pop()
            opened[t] -= 1
            if r is not None:
                depth[r] -= 1
            if t in LISTS:
                end_list()
            if t == tag:
                return

    def end_list() -> None:
        begin = lists.pop()
        if last[0] < begin:
            while menus and menus[-1][0] >= begin:
                menus.pop()
            menus.append((begin, len(blocks)))

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            flush()
        if m[1]:
            if opened.get(tag):
                close(tag)
            continue
        if tag in RAW or tag in SKIPPED:
            if not m[3].endswith("/"):
                done = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                if done is not None:
                    at = done.start()  # the end tag itself is read next and closes nothing
                elif tag in RAW:
                    at = end
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        if tag in BLOCKS and opened.get("head"):
            close("head")
        if tag in BLOCKS and opened.get("p"):
            close("p")
        inside = depth[ARTICLE] > 0
        own: int | None = attribute_role(tag, m[3], inside or depth[MAIN] > 0 or tag in ("article", "main")) if m[3] else None
        if tag in CHROME or tag == "header" and not inside:
            own = DROPPED
        elif tag == "article" and own is None:
            own = ARTICLE
        elif tag == "main" and own is None:
            own = MAIN
        if tag == "label" and not opened.get("form"):
            own = None
        if tag in LISTS:
            lists.append(len(blocks))
        stack.append((tag, own))
        opened[tag] = opened.get(tag, 0) + 1
        if own is not None:
            depth[own] += 1
    flush()
    while lists:
        end_list()
    for begin, end in menus:
        items = [i for i in range(begin, end) if blocks[i][0] == OPEN]
        if len(items) > 1:
            for i in items:
                blocks[i] = (DROPPED, True, blocks[i][2])
    return blocks


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower().removeprefix("www.") if m else ""


def hash_text(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), SEED)


#: Stands after the tokens of a block that is compared whole; tokens have odd numbers.
END = np.uint64(2)


class WordNumbers(dict):
    """Odd 64-bit numbers of words, up to WORDS_HELD of them."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        found = self[word] = hash_text(word) | 1
        return found


NUMBERS = WordNumbers()


def numbered_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd 64-bit numbers of all tokens in a row, and of each text its tokens and where they start."""
    tokens = [t.lower().split() for t in texts]
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    flat = np.fromiter(map(NUMBERS.__getitem__, chain.from_iterable(tokens)), dtype=np.uint64, count=int(sizes.sum()))
    return flat, sizes, np.cumsum(sizes) - sizes


def beginning(host: np.ndarray, tokens: list[np.ndarray]) -> np.ndarray:
    """Keys of beginnings of suffixes: their hosts' numbers and then token after token."""
    with np.errstate(over="ignore"):
        key = host + np.uint64(len(tokens))
        for t in tokens:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + t)
    return key.astype(np.int64)


def windows(host: str, flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray, lengths: tuple[int, ...] = (DEPTH, LONG)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, block, first token, tokens) of every beginning of a suffix inside the blocks: DEPTH and LONG tokens, or a short block whole."""
    block = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - starts[block] if len(flat) else np.zeros(0, dtype=np.int64)
    own = np.uint64(hash_text(host))
    found: list[tuple] = []
    for n in sorted({*lengths, *sizes[sizes < DEPTH].tolist()}):
        first = np.flatnonzero(at + n <= sizes[block]) if n >= DEPTH else starts[sizes == n]
        key = beginning(np.full(len(first), own), [flat[first + k] for k in range(n)])
        found.append((key, block[first], at[first], np.full(len(first), n)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffixes(host: str, flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray, block: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row for each place: the host's number and the first LONG tokens from there, 0 beyond the block's end; END after a short block."""
    cells = np.zeros((len(block), 1 + LONG), dtype=np.uint64)
    cells[:, 0] = np.uint64(hash_text(host))
    left = sizes[block] - at
    for k in range(LONG):
        held = left > k
        cells[held, 1 + k] = flat[(starts[block] + at)[held] + k]
    short = np.flatnonzero(sizes[block] < DEPTH)
    cells[short, 1 + left[short]] = END
    return cells


def as_bytes(cells: np.ndarray) -> pa.Array:
    """Rows of numbers as texts of bytes that sort as the rows do."""
    width = cells.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer((np.arange(len(cells) + 1) * width).astype(np.int32)), pa.py_buffer(cells.astype(">u8").tobytes())])


STATE = ("address_low", "address_high", "content_low", "content_high")


def runs_of_array(cells: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, state) of runs of neighbours in suffix order that agree in DEPTH, or LONG, tokens or as short blocks.

    state: of each suffix the lowest and highest address and content. Runs on one page alone
    are left out, but for those at either end, which may go on beyond it.
    """
    size = (cells[:, 1:] != 0).sum(axis=1)
    short = (cells[:, 1:] == END).any(axis=1)
    common = np.logical_and.accumulate(cells[1:] == cells[:-1], axis=1).sum(axis=1)  # of neighbours, the host included
    keys, states = [], []
    for n in (DEPTH, LONG):
        begin = np.flatnonzero(np.concatenate([[True], common <= n]))
        run = np.column_stack([f.reduceat(state[:, i], begin) for i, f in enumerate((np.minimum, np.maximum) * 2)])
        end = np.zeros(len(begin), dtype=bool)
        end[[0, -1]] = True
        wanted = (size[begin] >= n) & ~short[begin] & (end | (run[:, 0] != run[:, 1]) & (run[:, 2] != run[:, 3]))
        keys.append(beginning(cells[begin[wanted], 0], [cells[begin[wanted], 1 + k] for k in range(n)]))
        states.append(run[wanted])
    for n in np.unique(size[short]) - 1:  # without END
        rows = np.flatnonzero(short & (size == n + 1))
        keys.append(beginning(cells[rows, 0], [cells[rows, 1 + k] for k in range(n)]))
        states.append(state[rows])
    return np.concatenate(keys), np.concatenate(states)


def repeated_beginnings(found: DataFrame, scratch: Scratch) -> DataFrame:
    """key: beginnings on two distinct pages, by the suffix array over found (suffix, address, content)."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("address", "content") for n, f in (("low", F.min), ("high", F.max))]
    distinct = scratch.save(found.groupBy("suffix").agg(*ends), "suffixes")  # dealing into ranges reads them twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">u8").reshape(batch.num_rows, 1 + LONG).astype(np.uint64)
                key, state = runs_of_array(cells, np.column_stack([batch.column(i).to_numpy() for i in range(1, 5)]))
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(state[:, i]) for i in range(4))], names=["key", *STATE])

    sorted_suffixes = distinct.repartitionByRange("suffix").sortWithinPartitions("suffix").select("suffix", *STATE)
    parts = sorted_suffixes.mapInArrow(frugal(run), "key long, " + ", ".join(f"{c} long" for c in STATE))
    whole = parts.groupBy("key").agg(*[(F.min if c.endswith("low") else F.max)(c).alias(c) for c in STATE])
    return whole.where("address_low <> address_high and content_low <> content_high").select("key", F.lit(True).alias("repeated"))


def as_signed(x: int) -> int:
    return x - (1 << 63)


READ = "page_id long, url string, host string, kept array<string>, open array<string>"


def settled_and_open(blocks: list[tuple[int, bool, str]]) -> tuple[list[str], list[str]]:
    """(kept, open): the blocks that markup leaves open, and what it keeps before, between and after them."""
    best = max((b[0] for b in blocks), default=DROPPED)
    kept: list[list[str]] = [[]]
    left: list[str] = []
    for role, _, text in blocks:
        if role == best and best > OPEN:
            kept[-1].append(text)
        elif role != DROPPED:
            left.append(text)
            kept.append([])
    return ["\n\n".join(k) for k in kept], left


def read_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Each page's open blocks, and what markup keeps before, between and after them: without open blocks, its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, pages in chunks_of(batch.column(2)):
                urls = batch.column(1).slice(begin, len(pages))
                kept, left = zip(*(settled_and_open(read_blocks(html)) for html in pages), strict=True)
                hosts = [host_of(u) for u in urls.to_pylist()]
                columns = [pa.array(hosts, type=pa.string()), *(pa.array(x, type=pa.list_(pa.string())) for x in (kept, left))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(pages)), urls, *columns], names=["page_id", "url", "host", "kept", "open"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(frugal(run), READ)


def gathered(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Tables of columns, of a page each, put together to SLICE rows or more."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows >= SLICE:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, rows = [], 0
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def open_windows(undecided: DataFrame) -> DataFrame:
    """row, key, block, at, n: every beginning of a suffix in the open blocks."""

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for row, host, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, block, at, n = windows(host, *numbered_tokens(blocks))
                yield np.full(len(key), row), key, block, at, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in gathered(of_pages(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["row", "key", "block", "at", "n"])

    return undecided.select("row", "host", "open").mapInArrow(frugal(run), "row long, key long, block long, at long, n long")


def slots_of(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """(words of 64 slots, bits): the filter of the wanted keys, put together by Spark."""
    bits = min(FILTER_BITS, max(12, (wanted.count() * SLOTS_A_ROW).bit_length() - 1))
    slots = wanted.select(F.pmod(F.col("key"), F.lit(1 << bits)).alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("part"))
    made = slots.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))).alias("held")).toArrow()
    table = np.zeros(max(1, 1 << bits >> 6), dtype=np.uint64)
    table[made.column(0).to_numpy()] = made.column(1).to_numpy().view(np.uint64)
    return table, bits


def witnesses(pages: DataFrame, wanted: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """suffix, address, content: the suffixes with wanted beginnings on any page of their host, whatever their block's role.

    A wanted beginning of LONG tokens begins with one of DEPTH that is wanted too, so no others are looked for.
    """
    table, bits = slots_of(wanted.where(F.col("n") <= DEPTH))
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held = shared.value
        for batch in batches:
            for begin, pages in chunks_of(batch.column(2)):
                ids, urls = (batch.column(i).slice(begin, len(pages)).to_pylist() for i in (0, 1))
                for page_id, url, html in zip(ids, urls, pages, strict=True):
                    blocks = read_blocks(html)
                    host, (flat, sizes, starts) = host_of(url), numbered_tokens([b[2] for b in blocks])
                    key, block, at, _ = windows(host, flat, sizes, starts, (DEPTH,))
                    slot = key & ((1 << bits) - 1)
                    own = (held[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                    place = np.unique(starts[block[own]] + at[own])
                    block = np.searchsorted(starts, place, side="right") - 1  # no block is without tokens
                    address, content = as_signed(hash_text(url or f"#{page_id}")), as_signed(hash_text("\n".join(b[2] for b in blocks if b[0] != DROPPED)))
                    for i in range(0, len(place), SLICE):
                        part, at = block[i : i + SLICE], place[i : i + SLICE] - starts[block[i : i + SLICE]]
                        yield suffixes(host, flat, sizes, starts, part, at), np.full(len(part), address), np.full(len(part), content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells, *states in gathered(of_pages(batches)):
            yield pa.RecordBatch.from_arrays([as_bytes(cells), *(pa.array(x) for x in states)], names=["suffix", "address", "content"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(frugal(run), "suffix binary, address long, content long")


def unique_runs(kept: list[str], blocks: list[str], hits: list[tuple[int, int, int]]) -> str:
    """What markup keeps, and between it the blocks without what repeats: blocks that repeated substrings cover whole, and LONG runs in others. All blocks if nothing is left."""
    found = [kept[0]]
    tokens = [b.split() for b in blocks]
    covered = [np.zeros((2, len(t)), dtype=bool) for t in tokens]
    for block, at, n in hits:
        covered[block][0, at : at + n] = True
        covered[block][1, at : at + n] |= n >= LONG
    for t, c, after in zip(tokens, covered, kept[1:], strict=True):
        if not c[0].all():
            found.append(" ".join(w for w, gone in zip(t, c[1].tolist(), strict=True) if not gone))
        found.append(after)
    return "\n\n".join(x for x in found if x) or "\n\n".join(blocks)


def cut(judged: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            texts = [unique_runs(kept, blocks, [(h["block"], h["at"], h["n"]) for h in hits or []]) for kept, blocks, hits in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string())], names=["page_id", "url", "text"])

    return judged.select("page_id", "url", "kept", "open", "hits").mapInArrow(frugal(run), "page_id long, url string, text string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars, by_markup (whether markup alone settled it).

    Null and empty pages have empty texts. Pages without an address belong to one host of
    their own. Rows with one address, or with one content, are one page, so they don't repeat
    each other. A page of repeated open blocks alone keeps them. Other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "html-extraction")
    read = scratch.save(read_pages(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id()), "pages")
    out = read.where("size(open) = 0").select("page_id", "url", F.get("kept", F.lit(0)).alias("text"), F.lit(True).alias("by_markup"))
    undecided = read.where("size(open) > 0")
    if undecided.limit(1).count():  # else there is nothing to search for
        own = scratch.save(open_windows(undecided), "beginnings")
        repeated = scratch.save(repeated_beginnings(witnesses(pages, own, id_col, url_col, html_col), scratch), "repeated")
        scratch.drop("suffixes")
        hits = small_join(own, repeated, "key", F.col("row")).where("repeated")
        # Written, so that Spark knows their size: texts move only if they aren't few.
        hits = scratch.save(hits.groupBy("row").agg(F.collect_list(F.struct("block", "at", "n")).alias("hits")), "hits")
        scratch.keep("pages", "hits")
        out = out.unionByName(cut(undecided.join(hits, "row", "left")).withColumn("by_markup", F.lit(False)))
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "by_markup")
