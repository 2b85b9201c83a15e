"""From raw documents to a weighted training mixture: five stages, each written as Parquet and read back by the next.

1. language: texts without a letter, or whose language is uncertain, go: those in none of the learned languages, by the mean
   log-likelihood of their n-grams, and those torn between two of them.
2. near duplicates: of every group of similar texts (5-word shingles, Jaccard 0.8) the smallest doc_id stays.
3. benchmark: windows shared with benchmark items are cut out; texts that mostly consist of them go.
4. personal data: spans are replaced by their kind.
5. mixture: tokens, weight, passes and copies of every document; no document is lost, scarcer sources repeat.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text. Empty tables pass through, null
texts go in the first stage, extra columns are kept through all stages but the last, which replaces those named like its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm import decontaminate, jaccard, langid, mixing, pii
from textpulse.llm.tables import bounded_batches, stored, table

MIN_LANGUAGE_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OTHERS = "_others"


def _packed(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` and one struct with all others, so that no working column can clash with them."""
    others = [c for c in docs.columns if c not in COLUMNS]
    return docs.select(*(c for c in docs.columns if c in COLUMNS), *([F.struct(*(f"`{c}`" for c in others)).alias(OTHERS)] if others else []))


def _unpacked(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order; ``n_chars`` follows the text."""
    length = F.length("text").cast("bigint").alias("n_chars")
    return done.select(*(length if c == "n_chars" else F.col(c) if c in COLUMNS else F.col(OTHERS)[c].alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return _unpacked(langid.certain(_packed(docs), MIN_LANGUAGE_SCORE), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs, n=5, share=(80, 100))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    found = decontaminate.find_benchmark(_packed(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(decontaminate.remove_hits(found), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return _unpacked(pii.redact(pii.find_pii(_packed(docs))), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return mixing.mix(docs)


STAGES = [("language", language), ("near duplicates", near_duplicates), ("benchmark", benchmark),
          ("personal data", personal_data), ("mixture", mixture)]

ORACLE_SQL = None  # a trained model decides in the first stage, and blocks are permuted by Spark's hash in the last


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
