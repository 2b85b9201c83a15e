"""Wide <-> long and series <-> map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(wide: DataFrame, ids: list[str], values: list[str], name: str = "word", value: str = "value") -> DataFrame:
    return wide.unpivot(ids, values, name, value)


def pivot_vector(near: DataFrame, words: list[str], fill: float = 0.0) -> DataFrame:
    """A term's distance vector per group with one column per listed word; a word that is not retained reads ``fill``.

    For export only: the columns must be listed. Groups without a listed word keep their row.
    """
    return near.groupBy("grp").pivot("word", words).agg(F.first("dist")).na.fill(fill, words)


def pivot_known(long: DataFrame, ids: list[str], column: str, value: str) -> DataFrame:
    """A matrix with a row for each ``ids`` and a column for each value of ``column``, without rows and columns that are null throughout.

    For export: the names of the columns come to the driver, as they are the schema of the answer.
    """
    known = long.where(F.col(value).isNotNull())
    names = [r[0] for r in known.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return known.groupBy(*ids).pivot(column, names).agg(F.first(value))


def encode_series(series: DataFrame, value: str = "mean_prop") -> DataFrame:
    """One row per term holding the map (day, group) -> value."""
    entry = F.struct(F.struct("day", "grp").alias("key"), F.col(value).alias("value"))
    return series.groupBy("term").agg(F.map_from_entries(F.collect_list(entry)).alias("series"))


def decode_series(encoded: DataFrame, value: str = "mean_prop") -> DataFrame:
    return encoded.select("term", F.explode("series").alias("key", value)).select(
        F.col("key.day").alias("day"), F.col("key.grp").alias("grp"), "term", value)
