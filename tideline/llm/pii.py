"""Personal data: patterns for the base kinds, and terms that reveal them.

Base spans (mail and network addresses, card and phone numbers) are found by pattern, and
secrets (keys, tokens) by their own information: long runs of letters and digits with many
bits a character. A value found is a protected entity, and so is its class (an address's
domain, a number's leading digits, a network, all secrets), so that values of one document
count as well. A word anywhere in
a document can give its entities away. How much it does is estimated from the corpus: with
n(x) the documents that hold x, among N,

    PMI(t, e) = log2(N * n(t, e) / (n(t) * n(e))),  IC(e) = log2(N / n(e)),
    disclosure(t, e) = PMI(t, e) / IC(e),

1 where the word never stands without the entity, 0 where they are independent. All counts
are of whole documents. What few documents suggest may be chance: a pair counts only with
EVIDENCE bits of it, n(t, e) * PMI(t, e), and with SUPPORT different texts. In documents of
the entity, words that reach GENERALISE are generalised to their class, those that reach
REMOVE are removed.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordCoder, chunks_of, content_hash, frugal

# The base kinds in order, and their patterns. They are matched part by part,
# so that no run of characters is read again and again.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
SECRET = "secret"
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Secrets: runs of at least so many letters and digits, both among them, with at least so many bits a character.
SECRET_RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}(?![A-Za-z0-9])")
SECRET_BITS = 3.0
#: Distinct texts in which word and entity have to stand together (told apart by the least and the greatest hash).
SUPPORT = 2
#: Bits of evidence that a pair needs.
EVIDENCE = 20.0
#: Disclosure from which words are generalised, and from which they are removed.
GENERALISE = 0.85
REMOVE = 0.97
#: Words are runs of letters and digits, whatever their case.
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
#: Slots of the filters through which words are counted and found: fixed, whatever the number of terms.
FILTER_BITS = 22
#: Pairs of a document's words and entities that one task counts, about.
PAIRS = 1_000_000
SEED = 31

_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            found.append((start, free))
        at = text.find("@", free)
    return found


def find_ips(text: str) -> list[tuple[int, int]]:
    found = []
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((start, end))
            start = end + 1
    return found


def find_cards(text: str) -> list[tuple[int, int]]:
    spans = (m.span() for m in CARD.finditer(text))
    # Between a card's digits stands at most one character, so shorter and longer matches can't pass.
    return [(s, e) for s, e in spans if 16 <= e - s <= 37 and 16 <= len(d := NOT_DIGIT.sub("", text[s:e])) <= 19 and luhn(d)]


def find_phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15] if "+" in text else []


FINDERS = dict(zip(KINDS, (find_emails, find_ips, find_cards, find_phones), strict=True))


def bits_per_character(run: str) -> float:
    """Entropy of the run's characters."""
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def find_secrets(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Secrets that overlap no span."""
    found = []
    for m in SECRET_RUN.finditer(text):
        run, (a, b) = m[0], m.span()
        if not run.isalpha() and not run.isdigit() and bits_per_character(run) >= SECRET_BITS and not any(a < e and b > s for _, s, e in taken):
            found.append((SECRET, a, b))
    return found


def entity_keys(kind: str, value: str) -> tuple[int, int]:
    """Of a value and of its class: mail domain, network, first six digits of a card or four of a phone number."""
    if kind == "email":
        plain = value.lower()
        group = plain.rpartition("@")[2]
    elif kind == "ip":
        plain = ".".join(part.lstrip("0") or "0" for part in value.split("."))
        group = ".".join(plain.split(".")[:2])
    elif kind == SECRET:
        plain, group = value, ""
    else:
        plain = NOT_DIGIT.sub("", value)
        group = plain[: 6 if kind == "card" else 4]
    one, many = (xxhash.xxh3_64_intdigest(x, SEED) - (1 << 63) for x in (f"{kind}:{plain}", f"{kind} class:{group}"))
    return one, many


def term_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, SEED) - (1 << 63)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(k, s, e) for k, f in FINDERS.items() for s, e in f(text)]


def protected_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, then secrets."""
    base = base_spans(text)
    return base + find_secrets(text, base)


def words_beside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(term, start, end) of all words outside the spans."""
    covered = np.zeros(len(text) + 1, dtype=bool)
    for _, s, e in spans:
        covered[s:e] = True
    return [(term_key(m[0].casefold().encode("utf-8", "surrogatepass")), *m.span()) for m in WORD.finditer(text) if not covered[m.start() : m.end()].any()]


FOUND = (
    "id long, content long, spans array<struct<kind string, start int, stop int>>, secrets array<struct<kind string, start int, stop int>>, entities array<long>,"
    " words array<struct<term long, start int, stop int>>, text string"
)
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
_WORDS = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]))


def find_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, content (hash of the text), base spans by kind and start, secrets; where there are any also entities, the other words, and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks_of(batch.column(2)):
                spans, secrets, entities, words, held = [], [], [], [], []
                for text in texts:
                    own = protected_spans(text)
                    for into, kinds in ((spans, KINDS), (secrets, (SECRET,))):
                        into.append([{"kind": k, "start": s, "stop": e} for k, s, e in own if k in kinds])
                    entities.append(sorted({x for k, s, e in own for x in entity_keys(k, text[s:e])}))
                    words.append([{"term": t, "start": s, "stop": e} for t, s, e in words_beside(text, own)] if own else [])
                    held.append(text if own else None)
                columns = [pa.array(spans, type=_SPAN), pa.array(secrets, type=_SPAN), pa.array(entities, type=pa.list_(pa.int64())), pa.array(words, type=_WORDS), pa.array(held, type=pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, len(texts)) for i in (0, 1)), *columns], names=["id", "content", "spans", "secrets", "entities", "words", "text"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), content_hash(text), text).mapInArrow(frugal(run), FOUND)


def slots_of(keys: DataFrame) -> np.ndarray:
    """A filter of 2 ** FILTER_BITS slots that passes all terms; what else it passes a join removes."""
    slots = keys.select(F.pmod(F.col("term"), F.lit(1 << FILTER_BITS)).cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()
    table = np.zeros(1 << FILTER_BITS, dtype=bool)
    table[slots] = True
    return table


def count_elsewhere(docs: DataFrame, passed: np.ndarray, text_col: str) -> DataFrame:
    """term, n: in how many documents without protected values each word stands that the filter passes."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(passed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).astype(bool)
        coder, keys = WordCoder(1 << 18), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for _, texts in chunks_of(batch.column(0)):
                if len(coder.words) > coder.limit:
                    coder.clear()
                    keys = np.zeros(0, dtype=np.int64)
                codes, starts = coder.code([t.casefold() for t in texts if not protected_spans(t)], _WORD_BYTES)
                fresh = coder.words[len(keys) :]
                keys = np.concatenate([keys, np.fromiter(map(term_key, fresh), dtype=np.int64, count=len(fresh))])
                at = np.flatnonzero(table[keys[codes] % (1 << FILTER_BITS)]) if len(codes) else codes
                doc = np.searchsorted(starts, at, side="right") - 1
                once = np.unique(doc * len(keys) + codes[at]) % max(1, len(keys))
                found, n = np.unique(keys[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.int64()), pa.array(n.astype(np.int64))], names=["term", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(frugal(run), "term long, n long")


def words_passed(found: DataFrame, passed: np.ndarray) -> DataFrame:
    """row, content, salts, term, start, stop, first (in its document) of the found rows' words that the filter passes."""
    shared = found.sparkSession.sparkContext.broadcast(np.packbits(passed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            words = batch.column(3)
            flat = words.flatten()
            terms = flat.field("term").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
            at = np.flatnonzero(table[terms % (1 << FILTER_BITS)])
            first = np.zeros(len(at), dtype=bool)
            if len(at):
                order = np.lexsort((terms[at], row[at]))
                r, t = row[at][order], terms[at][order]
                first[order[np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1])])]] = True
            for i in range(0, len(at), 50_000):
                own = at[i : i + 50_000]
                rows = [batch.column(k).take(pa.array(row[own])) for k in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [*rows, pa.array(terms[own]), *(flat.field(c).take(pa.array(own)) for c in ("start", "stop")), pa.array(first[i : i + 50_000])],
                    names=["row", "content", "salts", "term", "start", "stop", "first"],
                )

    rows = found.select("row", "content", salts().alias("salts"), "words")
    return rows.mapInArrow(frugal(run), "row long, content long, salts int, term long, start int, stop int, first boolean")


def salts() -> Column:
    """Parts into which the pairs of a found row are dealt: one for each PAIRS of words and entities."""
    return F.ceil(F.greatest(F.lit(1.0), F.size("words").cast("double") * F.size("entities") / PAIRS)).cast("int")


def several(column: str) -> Column:
    """SUPPORT different texts."""
    return F.min(column) != F.max(column)


def same_rows() -> list[Column]:
    """Fingerprint of the rows that a term or an entity stands in, whatever their order."""
    return [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"rows{k}") for k in (1, 2)]


def disclosures(found: DataFrame, docs: DataFrame, scratch: Scratch, text_col: str, evidence: float = EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """term, class, and row, class, disclosure: the largest one, from GENERALISE on, with an entity of the row.

    Terms that stand in the same documents have the same disclosures, and so have entities.
    One of each such class stands for all, so documents that share all their words and values
    give as many pairs as they have classes, not words times values.
    """
    size = float(found.count())
    marked = found.where(F.size("entities") > 0)
    of_entity = marked.select("row", "content", salts().alias("salts"), F.explode("entities").alias("entity"))
    entities = of_entity.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), several("content").alias("several"), *same_rows())
    entities = entities.where("several").groupBy("rows1", "rows2", "n_entity").agg(F.min("entity").alias("entity"))
    entities = scratch.save(entities.select("entity", "n_entity"), "entities")
    # n(t) <= n(t, e) * (N / n(e)) ** (1 - GENERALISE), and n(t, e) <= n(e): more frequent words reveal nothing.
    reach = F.pow("n_entity", F.lit(GENERALISE)) * F.pow(F.lit(size), F.lit(1 - GENERALISE))
    most = entities.agg(F.max(reach)).first()[0] or 0.0
    everything = np.ones(1 << FILTER_BITS, dtype=bool)
    inside = words_passed(marked, everything).where("first").groupBy("term").agg(F.count(F.lit(1)).alias("inside"), several("content").alias("several"), *same_rows())
    inside = scratch.save(inside.where((F.col("inside") <= most) & F.col("several")).drop("several"), "inside")
    outside = count_elsewhere(docs, slots_of(inside), text_col).groupBy("term").agg(F.sum("n").alias("more"))
    terms = inside.join(outside, "term", "left").withColumn("n", F.col("inside") + F.coalesce("more", F.lit(0))).where(F.col("n") <= most)
    terms = scratch.save(terms.select("term", "n", "inside", "rows1", "rows2"), "terms")
    classes = scratch.save(terms.groupBy("rows1", "rows2", "inside", "n").agg(F.min("term").alias("class")), "classes")

    of_class = words_passed(marked, slots_of(classes.select(F.col("class").alias("term")))).where("first").select("row", "content", "salts", F.col("term").alias("class"))
    of_class = of_class.join(classes.select("class"), "class").withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int"))
    of_class = scratch.save(of_class.drop("salts"), "terms by row")
    of_entity = scratch.save(of_entity.join(entities.select("entity"), "entity"), "entities by row")
    dealt = of_entity.select("row", "entity", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = of_class.join(dealt, ["row", "salt"]).groupBy("entity", "class").agg(F.count(F.lit(1)).alias("both"), several("content").alias("several")).where("several")
    held = scratch.save(pairs.drop("several"), "pairs").join(classes.select("class", "n"), "class").join(entities, "entity")
    pmi, content = F.log2(F.lit(size) * F.col("both") / (F.col("n") * F.col("n_entity"))), F.log2(F.lit(size) / F.col("n_entity"))
    held = held.select("entity", "class", F.try_divide(pmi, content).alias("disclosure"), (F.col("both") * pmi).alias("evidence"))
    strong = scratch.save(held.where((F.col("disclosure") >= GENERALISE) & (F.col("evidence") >= evidence)).drop("evidence"), "strong")

    # A strong pair shares a good part of its term's rows, so this join is of the order of its result.
    near = of_class.select("row", "class").join(strong, "class").join(of_entity.select("row", "entity"), ["row", "entity"])
    near = near.groupBy("row", "class").agg(F.max("disclosure").alias("disclosure"))
    members = terms.join(classes, ["rows1", "rows2", "inside", "n"]).select("term", "class")
    members = members.join(strong.select("class").distinct(), "class", "left_semi")
    return scratch.save(members, "members"), scratch.save(near, "disclosures")


def word_class(word: str) -> str:
    """What a word is generalised to."""
    if re.fullmatch("[0-9]+", word):
        return "[number]"
    if re.search("[0-9]", word):
        return "[code]"
    return "[name]" if unicodedata.category(word[0]) == "Lu" else "[word]"


def cleaned(text: str, spans: list[dict], terms: list[dict]) -> str:
    """The text with [email] and so on for spans, the class of generalised words, and nothing for removed ones, in one walk over both."""
    marks = [(s["start"], s["stop"], f"[{s['kind']}]") for s in spans]
    marks += [(t["start"], t["stop"], "" if t["disclosure"] >= REMOVE else word_class(text[t["start"] : t["stop"]])) for t in terms]
    out, at = [], 0
    for start, stop, by in sorted(marks):
        if start >= at:  # of overlapping marks the first counts
            out += [text[at:start], by]
        at = max(at, stop)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind string, start int, stop int>>"
CLEANED = f"id long, content long, spans {_SPANS}, secrets {_SPANS}, terms array<struct<kind string, start int, stop int, disclosure double>>, clean_text string"


def with_clean_text(rows: DataFrame) -> DataFrame:
    """id, content, spans, secrets, terms as they are, and clean_text, null where nothing was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                cleaned(text, spans + secrets, terms) if spans or secrets else None
                for spans, secrets, terms, text in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(texts, type=pa.string())], names=["id", "content", "spans", "secrets", "terms", "clean_text"])

    return rows.select("id", "content", "spans", "secrets", "terms", "text").mapInArrow(frugal(run), CLEANED)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", evidence: float = EVIDENCE) -> DataFrame:
    """One row per document: id, content, spans and secrets (kind, start, stop), terms (kind, start, stop, disclosure), by start within a kind, clean_text.

    clean_text is the text without what was found, null where nothing was. Null texts are
    empty texts: no spans. Repeated rows are judged each by itself, but an entity has to meet a
    word in SUPPORT different texts. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.save(find_base(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "found")
    members, strong = disclosures(found, docs, scratch, text_col, evidence)
    scratch.keep("found", "members", "disclosures")
    words = words_passed(found.where(F.size("entities") > 0), slots_of(members)).select("row", "term", "start", "stop")
    words = words.join(members, "term").join(strong, ["row", "class"])
    term = F.struct(F.lit(TERM).alias("kind"), "start", "stop", "disclosure")
    words = words.groupBy("row").agg(F.sort_array(F.collect_list(term)).alias("terms"))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int,disclosure:double>>")
    out = found.join(words, "row", "left").withColumn("terms", F.coalesce("terms", none))
    return with_clean_text(out).withColumnRenamed("id", id_col)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", evidence: float = EVIDENCE) -> DataFrame:
    """The documents with text cleaned: [email] and so on for base spans, the class of generalised words, nothing for removed ones.

    Rows meet their clean text by id and content, so rows that repeat an id, or have none, keep
    what is theirs.
    """
    new = detect(docs, id_col, text_col, evidence).where("clean_text is not null").dropDuplicates([id_col, "content"])
    new = new.select(F.col(id_col).alias("__id"), F.col("content").alias("__content"), F.col("clean_text").alias("__clean"))
    held = docs.join(new, docs[id_col].eqNullSafe(new["__id"]) & (content_hash(docs[text_col]) == new["__content"]), "left")
    return held.withColumn(text_col, F.coalesce("__clean", text_col)).select(*docs.columns)
