"""Quality classifier: perplexity under a Kneser-Ney model of trusted running text.

The counts of the trusted documents are joined, shard by shard, with totals, discounts and
shorter orders (kneser_ney.estimate); every document's perplexity then follows. One in HELD_OUT
of the trusted documents isn't counted: a language's limit is a quantile of what these reach,
so it is that of texts which the model hasn't seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney
from .common import Scratch, small_join

#: The quantile of held-out trusted documents' log perplexity that is the limit, and what is added to it.
QUANTILE = 0.98
MARGIN = 0.02
HELD_OUT = 5


def trusted_only(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The documents that labels call good; conflicting labels of one document count as bad.

    Labels grow with the documents, so they are joined by a shuffle at every size.
    """
    good = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__good")).where("__good = 1 and __id is not null")
    return docs.join(good.hint("merge"), docs[id_col] == good["__id"], "left_semi")


def held_out(id_col: str):
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(HELD_OUT)) == 0


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    margin: float = MARGIN,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, lang, n_symbols, log_perplexity, limit (of its language and length), kept.

    A document without words has no perplexity and isn't kept. A language without trusted
    documents has no limit: nothing speaks against its documents, so those with words are
    kept; where none of them is held out, all of them give the limit. Repeated rows are judged
    alike; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality-classifier")
    trusted = trusted_only(docs.select(id_col, lang_col, text_col), labels, id_col)
    model = kneser_ney.train(trusted.where(~held_out(id_col)), lang_col, text_col, running=True)
    scored = scratch.save(kneser_ney.perplexities(docs, model, id_col, lang_col, text_col), "scored")
    model.destroy()
    known = trusted_only(scored.withColumnRenamed("id", id_col), labels, id_col).withColumn("value", F.col("log_perplexity") - kneser_ney.spread("n_symbols"))
    known = scratch.save(known.select(id_col, "lang", "value"), "known")
    all_of, unseen = (kneser_ney.quantiles_by_language(x, [quantile], value="value") for x in (known, known.where(held_out(id_col))))
    limits = small_join(all_of.withColumnRenamed("q0", "seen"), unseen, "lang", F.col("lang")).select("lang", (F.coalesce("q0", "seen") + margin).alias("limit"))
    out = small_join(scored, scratch.save(limits, "limits"), "lang", F.col("id"))
    scratch.keep("scored", "limits")
    out = out.withColumn("limit", F.col("limit") + kneser_ney.spread("n_symbols"))
    kept = F.col("log_perplexity").isNotNull() & F.coalesce(F.col("log_perplexity") <= F.col("limit"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "lang", "n_symbols", "log_perplexity", "limit", kept.alias("kept"))
