"""Vocabularies: per group, shared, common, pruned and capped.

Everything is derived from one aggregate of (group, term) statistics. It is combined on the map side, so what crosses
the network is distinct terms per task and not tokens, and a frequent term is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TERMS = 1000


def corpus_size(docs: DataFrame) -> Column:
    """Number of documents as a scalar sub-query; it counts documents that have no token left."""
    return docs.agg(F.count("*").alias("n")).scalar()


def group_term_stats(tf: DataFrame) -> DataFrame:
    """Document frequency and total count per (group, term).

    ``tf`` has one row per document and term, or ``df`` and ``cf`` of some documents each (``counts.group_counts``).
    """
    df, cf = (F.sum("df"), F.sum("cf")) if "df" in tf.columns else (F.count("*"), F.sum("tf"))
    return tf.groupBy("grp", "term").agg(df.alias("df"), cf.alias("cf"))


def term_totals(tf: DataFrame) -> DataFrame:
    """Document frequency and total count per term, over all groups."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def vocab_per_group(stats: DataFrame, min_df: int = 5) -> DataFrame:
    return stats.where(F.col("df") >= min_df).select("grp", "term", "df")


def vocab_shared(per_group: DataFrame, min_groups: int = 2) -> DataFrame:
    """Terms in the vocabulary of at least ``min_groups`` groups."""
    return per_group.groupBy("term").agg(F.count("*").alias("n_groups")).where(F.col("n_groups") >= min_groups)


def vocab_common(stats: DataFrame, docs: DataFrame, min_df: int | float = 2, max_df: int | float = 0.3) -> DataFrame:
    """``(term, df, cf)`` of the terms inside the frequency limits of every group.

    A term has to pass in all groups, so its sums over the groups are its corpus totals. Groups too small to have any
    such term make the vocabulary empty.
    """
    sizes = docs.groupBy("grp").agg(F.count("*").alias("n"))
    n_groups = sizes.agg(F.count("*").alias("n_groups")).scalar()
    within = stats.join(sizes, "grp").where(_between(min_df, max_df, F.col("n")))
    sums = within.groupBy("term").agg(F.count("*").alias("_g"), F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return sums.where(F.col("_g") == n_groups).select("term", "df", "cf")


def prune(terms: DataFrame, n_docs: Column, min_df: int | float, max_df: int | float, cap: int | None) -> DataFrame:
    """Terms inside corpus-wide limits, capped to the highest total counts.

    Whole numbers are absolute limits, fractions are relative to ``n_docs``. Equal counts are cut in term order.
    """
    kept = terms.where(_between(min_df, max_df, n_docs)).select("term", "df", "cf")
    return kept if cap is None else kept.orderBy(F.desc("cf"), "term").limit(cap)


def vocab_pruned(stats: DataFrame, n_docs: Column, min_df: int | float = 10, max_df: int | float = 0.5,
                 cap: int | None = MAX_TERMS, group_min_df: int | None = None, min_groups: int = 2) -> DataFrame:
    """``prune`` over the corpus totals of all terms.

    With ``group_min_df`` the shared vocabulary's rule (that document frequency in ``min_groups`` groups) is applied in
    the same pass.
    """
    shared = F.count_if(F.col("df") >= (group_min_df or 0)) >= min_groups if group_min_df else F.lit(True)
    totals = stats.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), shared.alias("_shared"))
    return prune(totals.where("_shared"), n_docs, min_df, max_df, cap)


def most_frequent(vocab: DataFrame, n: int) -> DataFrame:
    """The ``n`` terms with the highest total count, ties by term."""
    return vocab.orderBy(F.desc("cf"), "term").limit(n).select("term")


def _between(min_df: int | float, max_df: int | float, n: Column) -> Column:
    bound = lambda x: F.lit(x) * n if isinstance(x, float) else F.lit(x)
    return (F.col("df") >= bound(min_df)) & (F.col("df") <= bound(max_df))
