"""Ranks of terms within a day and group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpulse.functions.numeric import tie_safe, zero_as_null
from textpulse.operators.trends import WINDOW


def smoothed(series: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rolling mean in which a zero is "not observed": it is null, and a null row takes its window's mean."""
    frame = Window.partitionBy("grp", "term").orderBy("day").rowsBetween(1 - window, 0)
    return series.select("day", "grp", "term", tie_safe(F.avg(zero_as_null(F.col("mean_prop"))).over(frame)).alias("v"))


def term_rank(series: DataFrame, window: int = WINDOW) -> DataFrame:
    """Descending rank over all terms of a (day, group), equal values sharing their mean rank, null staying null."""
    cell = Window.partitionBy("day", "grp")
    place = F.rank().over(cell.orderBy(F.desc_nulls_last("v")))
    ties = F.count("*").over(Window.partitionBy("day", "grp", "v"))
    rank = F.when(F.col("v").isNotNull(), place + (ties - 1) / 2.0)
    return smoothed(series, window).select("day", "grp", "term", rank.alias("rank"))


def term_rank_ordinal(values: DataFrame, value: str = "mean_prop") -> DataFrame:
    """Ascending 0-based position over the terms of a (day, group), ties by term, null as -1."""
    order = Window.partitionBy("day", "grp").orderBy(F.asc_nulls_last(value), "term")
    rank = F.when(F.col(value).isNull(), F.lit(-1)).otherwise(F.row_number().over(order) - 1)
    return values.select("day", "grp", "term", rank.alias("rank"))


def top_term(ranks: DataFrame, terms: list[str]) -> DataFrame:
    """The best-ranked of the chosen terms per (day, group), null where none of them has a rank.

    ``ranks`` must come from the full vocabulary: choosing terms before ranking would change the ranks.
    """
    ranked = F.when(F.col("rank").isNotNull(), F.struct("rank", "term"))
    return ranks.where(F.col("term").isin(terms)).groupBy("day", "grp").agg(F.min(ranked)["term"].alias("term"))


def align_series(series: DataFrame, terms: list[str], value: str = "mean_prop") -> DataFrame:
    """One column per chosen term on the full outer set of (day, group), in time order."""
    known = series.where(F.col("term").isin(terms))
    return known.groupBy("day", "grp").pivot("term", terms).agg(F.first(value)).orderBy("day", "grp")
