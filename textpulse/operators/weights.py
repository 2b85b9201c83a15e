"""Smoothed, L2-normalised TF-IDF in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse.operators.sizes import small


def idf(vocab: DataFrame, n_docs: Column) -> DataFrame:
    """``ln((1 + n) / (1 + df)) + 1`` per term."""
    return vocab.select("term", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(tf: DataFrame, vocab: DataFrame, n_docs: Column, key: str = "doc_id",
          vocab_rows: int | None = None) -> DataFrame:
    """``tf`` restricted to the vocabulary, with weight ``w``; a document without kept terms has no row.

    ``vocab_rows`` is the vocabulary's cap or count; a small one goes to the tokens by broadcast. Only kept terms are
    shuffled, once, by document, to divide by the document's norm.
    """
    weights = idf(vocab, n_docs)
    raw = tf.join(small(weights, vocab_rows), "term").withColumn("_x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(key)))
    return raw.withColumn("w", F.col("_x") / norm).drop("_x", "idf", "tf")
