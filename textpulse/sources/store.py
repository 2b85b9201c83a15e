"""Derived tables: write, point read, keyed merge, append, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_term(df: DataFrame, path: str, term: str = "term", mode: str = "overwrite") -> None:
    """Parquet laid out for point reads: terms range over the files and are sorted inside each.

    Range partitioning on the term and the remaining columns splits a term that is too large for one file.
    """
    rest = [c for c in df.columns if c in ("grp", "day", "other", "word")]
    df.repartitionByRange(term, *rest).sortWithinPartitions(term, *rest).write.mode(mode).parquet(path)


def read_terms(spark: SparkSession, path: str, terms: list[str] | None = None, term: str = "term") -> DataFrame:
    """Rows of the given terms; row-group statistics skip the rest. No known term gives an empty result."""
    stored = spark.read.parquet(path)
    return stored if terms is None else stored.where(F.col(term).isin(list(terms)))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def merge_latest(stored: DataFrame, fresh: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Field-wise merge of two snapshots: per key, each field takes its newest value that is set.

    A field that the newer rows do not carry survives from the older ones. ``max_by`` combines before the shuffle, so
    one key holding a third of all rows costs no more than one row per task.
    """
    both = stored.unionByName(fresh, allowMissingColumns=True)
    fields = [c for c in both.columns if c not in keys and c not in version]
    order = F.struct(*version)
    return both.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields],
        *[F.max(order).getField(v).alias(v) for v in version],
    )


def upsert_snapshot(spark: SparkSession, current: str | None, fresh: DataFrame, target: str,
                    keys: list[str], version: list[str]) -> str:
    """Write the merge of the snapshot at ``current`` and ``fresh`` to a new path and return it."""
    stored = spark.read.parquet(current) if current else fresh.limit(0)
    merge_latest(stored, fresh, keys, version).write.mode("overwrite").parquet(target)
    return target


def delete_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return df.join(keys, on, "left_anti")
