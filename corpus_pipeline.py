"""A corpus pipeline: language ID, toxicity, line dedup, near-dedup, packing.

Each stage takes what its predecessor kept, as written and read again, and all but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, linededup, packing, simhash, toxicity
from tessera.llm.common import held_out
from tessera.sources.tables import materialize, release, table

#: Documents with a language whose pooled probability is below this are rejected, as are those
#: without a language; toxic from this score on.
LEAST_LANGUAGE, TOXIC = 0.3, 0.7
#: Share of a source's other documents from which a line goes; a source has hundreds to thousands of documents, of which license lines are on 0.6 to 0.8 %.
BOILERPLATE = 0.005


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: with a letter in the text, and a pooled probability of LEAST_LANGUAGE or more. Null and empty
    texts go; null ids, languages and sources, repeated rows and other columns stay as they are."""
    model = langid.fit(docs.where(~held_out()))
    named = docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns])  # apart from the names of what is found
    kept = langid.predict(named, model, "d_text").where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE))
    return kept.select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below TOXIC. Null and empty texts score 0 and stay; repeated rows share their fate; all columns stay."""
    weights = toxicity.fit(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    named = docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns])
    return toxicity.score(named, weights, "d_text").where(F.col("score") < TOXIC).select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that too many different documents of their source share; null sources are one source, null texts stay null.
    n_chars, where there is such a column, is counted again."""
    out = linededup.drop_boilerplate(docs, "source", ratio=BOILERPLATE).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; null ids come last. Texts without words are one group."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packing.pack, of every document that is left; a null text is packed as an empty one."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("toxicity", clean), ("line_dedup", lines), ("simhash_near_dedup", near_dedup), ("packing", packed)]
#: No SQL: trained models, fingerprints and tokens; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
