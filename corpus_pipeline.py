"""A corpus pipeline: quality rules, exact copies, near copies, source mixing, packing.

Each stage takes the documents that its predecessor kept and returns documents, the last
one the packed pieces. run() writes every stage's rows to the shared folder before the
next one reads them, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import exact_dedup, mixing, ngram_jaccard, quality_rules
from tideline.llm.common import Scratch
from tideline.llm.queries import packed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no perplexity band rejects.

    Null and empty texts have fewer words than the rules ask for and go. A null language is
    one with bands of its own. Repeated rows are judged alike. Further columns are left out.
    """
    return quality_rules.keep_good(docs).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest id.

    Null texts equal empty ones. Of rows that repeat an id and its text one stays; a row
    without id stays only where no equal text has an id.
    """
    return exact_dedup.drop_exact_copies(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Texts without words are near to nothing and stay. Rows are told apart by id and text, so
    rows that repeat both stay together; rows without id take part and yield to those with one.
    """
    return ngram_jaccard.keep_first(docs).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says, in one global random order.

    A null source is a source of its own; rows without id have numbers of their own. Copies
    are equal rows of documents' columns; packing tells them apart by row.
    """
    return mixing.mix(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, as the packing query returns them: (doc_row, start) is unique, whatever the copies of a document.

    A null or empty text is packed as its end id. Pieces lie by bucket and, within it, in
    random order, so what mixing shuffled stays shuffled.
    """
    return packed(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("source mixing", source_mix),
    ("packing", packing),
]

#: Packing needs a tokenizer, and near copies and bands a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.keep(name)
    return docs
