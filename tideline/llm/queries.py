"""The registered queries of the subpackage, each over its whole table, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hamming_dedup, html_extraction, mixing, ngram_jaccard, packing, phrases, pii, quality_classifier, quality_rules, spelling, token_counts, toxicity

#: Tokenizer files are read where they are installed.
PACKING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
COUNTING_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH RECURSIVE s AS (
    SELECT source, count(*) AS n, pow(count(*), {mixing.TEMPERATURE}) AS w FROM documents GROUP BY source
), r AS (
    SELECT source, (SELECT sum(n) FROM s) * w / (SELECT sum(w) FROM s) / n AS rate FROM s
), p AS (
    SELECT source, greatest(1, CAST(ceil(rate / {mixing.MAX_MEAN}) AS INTEGER)) AS parts,
           rate / greatest(1, CAST(ceil(rate / {mixing.MAX_MEAN}) AS INTEGER)) AS mean FROM r
), c AS (
    SELECT source, parts, mean, 0 AS k, exp(-mean) AS pk, exp(-mean) AS cdf FROM p
    UNION ALL
    SELECT source, parts, mean, k + 1, pk * mean / (k + 1), cdf + pk * mean / (k + 1) FROM c WHERE k + 1 < {mixing.TERMS}
), t AS (
    SELECT source, any_value(parts) AS parts, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source
), x AS (
    SELECT d.*, list_sum([len([v FOR v IN t.cdf IF v <
             (CAST('0x' || md5('{mixing.SEED}:' || d.doc_id || ':' || i)[1:13] AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE])
             FOR i IN range(t.parts)]) AS number
    FROM documents d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       md5('order-{mixing.SEED}:' || doc_id || ':' || copy) AS shuffle_key
FROM (SELECT * EXCLUDE (number), unnest(range(CAST(number AS BIGINT))) AS copy FROM x)
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), COUNTING_VOCABULARY)


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, PACKING_TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "doc_row")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def spans_text(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    part = lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, part), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents"))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    plain = F.transform("terms", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    everything = spans_text(F.concat("spans", "secrets", plain)).alias("spans")
    more = [F.size("secrets").cast("long").alias("n_secrets"), F.size("terms").cast("long").alias("n_terms"), (F.size("spans") + F.size("secrets") > 0).cast("int").alias("personal"), "clean_text"]
    return found.select("doc_id", *counts, F.sha2(spans_text("spans"), 256).alias("base_sha256"), everything, *more)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(read(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH lowered AS (
    SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL
), cut AS (
    SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM lowered
), pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut
), totals AS (
    SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang
), grams AS (
    SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*)::HUGEINT AS f
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, {phrases.LONGEST + 1}) AS ks(k))
    GROUP BY ALL HAVING count(*) >= {phrases.LEAST}
), phrases AS (
    SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM grams WHERE k > 1
), inner_parts AS (
    SELECT DISTINCT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, f
    FROM (SELECT lang, w, f, j, unnest(range(1, k - j + 2)) AS i FROM phrases, range(2, {phrases.LONGEST}) AS js(j) WHERE j < k)
), kept AS (
    SELECT * FROM phrases p WHERE NOT EXISTS (SELECT 1 FROM inner_parts q WHERE q.lang = p.lang AND q.phrase = p.phrase AND 100 * q.f >= 100 * p.f)
), cuts AS (
    SELECT p.lang, p.phrase, p.f AS a, c, l.f AS l, r.f AS r, t.n, (1000 * p.f * t.n) // (l.f * r.f) AS score
    FROM (SELECT *, unnest(range(1, k)) AS c FROM kept) p
    JOIN totals t ON t.lang = p.lang
    JOIN grams l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1:c], ' ')
    JOIN grams r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[c + 1:], ' ')
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest QUALIFY rank <= {phrases.TOP}
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


#: CRC-32 is worked out bit by bit. Near words share what is left without one code point.
OP12_SQL = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name, run, count(*) AS n FROM runs GROUP BY ALL
), bits AS (
    SELECT run, n, list_transform(range(octet_length(encode(name)) * 8), lambda i: get_bit(bits, CAST(i // 8 * 8 + 7 - i % 8 AS INTEGER))) AS b
    FROM (SELECT *, CAST(encode(name) AS BIT) AS bits FROM counted)
), hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(b, lambda x: x::UBIGINT)),
        lambda c, x: xor(c >> 1, CASE WHEN xor(c & 1, x) = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)), 4294967295::UBIGINT) AS h
    FROM bits
), typed AS (
    SELECT CASE WHEN h % {spelling.TYPOS} = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed GROUP BY word HAVING sum(n) >= {spelling.LEAST} AND length(word) >= {spelling.SHORTEST}
), less AS (
    SELECT word, n, i, left(word, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), near AS (
    SELECT x.word, y.word AS other, y.n FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM less x JOIN words y ON x.rest = y.word
    UNION SELECT y.word, x.word, x.n FROM less x JOIN words y ON x.rest = y.word
), best AS (
    SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, n AS form_n FROM near
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1
), forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= {spelling.RATIO} * w.n THEN b.other END AS form,
           CASE WHEN b.form_n >= {spelling.RATIO} * w.n THEN b.form_n END AS form_n
    FROM words w LEFT JOIN best b USING (word)
), chain AS (
    SELECT word, word AS root, form AS ahead FROM forms
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.ahead
)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN chain c ON c.word = f.word AND c.ahead IS NULL
"""


def op13_hamming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_dedup.near_duplicates(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)
), s AS (
    SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
    SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.component_id, w.doc_id = r.component_id AS kept
FROM w LEFT JOIN s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_mixing": op3_mixing,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_token_counts": op5_token_counts,
        "op6_packing": op6_packing,
        "op7_pii": op7_pii,
        "op8_quality_rules": op8_quality_rules,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_html_extraction": op10_html_extraction,
        "op11_collocations": op11_collocations,
        "op12_spelling": op12_spelling,
        "op13_hamming_dedup": op13_hamming_dedup,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op3_mixing": OP3_SQL, "op11_collocations": OP11_SQL, "op12_spelling": OP12_SQL, "op13_hamming_dedup": OP13_SQL}
