"""Row cleaning, predicates and option lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALL = "All"


def dedupe(df: DataFrame) -> DataFrame:
    """Exact duplicate rows, over all columns present, are kept once."""
    return df.dropDuplicates()


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a null in the given columns (default: in any)."""
    return df.na.drop("any", subset=columns)


def in_groups(df: DataFrame, groups: Iterable[str] | None, column: str = "grp") -> DataFrame:
    """Rows of the chosen groups; None, or a choice that includes "All", adds no predicate."""
    if groups is None or ALL in (chosen := list(groups)):
        return df
    return df.where(F.col(column).isin(chosen))


def pairs_touching(pairs: DataFrame, groups: Iterable[str] | None) -> DataFrame:
    """Group pairs of which at least one side is chosen."""
    if groups is None or ALL in (chosen := list(groups)):
        return pairs
    return pairs.where(F.col("g1").isin(chosen) | F.col("g2").isin(chosen))


def pair_groups(pairs: DataFrame) -> DataFrame:
    """The set of groups named on either side of the pairs."""
    return pairs.select(F.explode(F.array("g1", "g2")).alias("grp")).distinct()


def distinct_groups(df: DataFrame, column: str = "grp") -> DataFrame:
    return df.select(column).distinct()


def first_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by an explicit order; the group limit runs before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def first_n(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows by ``order``; None keeps all."""
    return df if n is None else df.orderBy(*order).limit(n)


def group_doc_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("grp").agg(F.count("*").alias("n"))
