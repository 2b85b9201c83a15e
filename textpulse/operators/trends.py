"""How a term's weight moves and how groups share it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpulse.functions.numeric import null_as_zero

WINDOW = 14


def day_group_frame(docs: DataFrame) -> DataFrame:
    """Every observed day for every group, with ``n_docs`` null where the group has no document that day."""
    cells = docs.groupBy("day", "grp").agg(F.count("*").alias("n_docs"))
    # The list of days is bounded by the calendar, whatever the number of documents.
    days = cells.agg(F.collect_set("day")).scalar()
    frame = cells.select("grp").distinct().select("grp", F.explode(days).alias("day"))
    return frame.join(cells, ["day", "grp"], "left")


def term_day_mean(weights: DataFrame, docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Mean weight per (day, group, term) over all documents of the cell, dense over days, groups and ``vocab``.

    Three states: a value; 0 where the cell has documents but none with the term; null where it has no document.
    """
    terms = vocab.agg(F.collect_set("term")).scalar()
    dense = day_group_frame(docs).select("day", "grp", "n_docs", F.explode(terms).alias("term"))
    sums = weights.groupBy("day", "grp", "term").agg(F.sum("w").alias("_sum"))
    return dense.join(sums, ["day", "grp", "term"], "left").select(
        "day", "grp", "term", (null_as_zero(F.col("_sum")) / F.col("n_docs")).alias("mean_prop"))


def word_trend(series: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rolling mean over the last ``window`` rows per (group, term); a null day counts as 0."""
    shown = series.withColumn("mean_prop", null_as_zero(F.col("mean_prop")))
    frame = Window.partitionBy("grp", "term").orderBy("day").rowsBetween(1 - window, 0)
    return shown.withColumn("rolling", F.avg("mean_prop").over(frame))


def words_union(series: DataFrame, words: list[str] | DataFrame) -> DataFrame:
    """The series of the chosen words in one table, tagged with the word; no known word gives no row."""
    chosen = (series.join(words.select("term"), "term", "left_semi") if isinstance(words, DataFrame)
              else series.where(F.col("term").isin(list(words))))
    return chosen.select("day", "grp", F.col("term").alias("word"), null_as_zero(F.col("mean_prop")).alias("mean_prop"))


def word_proportion(words: DataFrame) -> DataFrame:
    """Mean of the daily means per (group, word)."""
    return words.groupBy("grp", "word").agg(F.avg("mean_prop").alias("overall_prop"))


def group_share(proportion: DataFrame) -> DataFrame:
    """Each group's part of a word's total. A single selected group keeps its own value."""
    per_word = Window.partitionBy("word")
    total = F.sum("overall_prop").over(per_word)
    alone = F.count("*").over(per_word) == 1
    share = F.when(alone, F.col("overall_prop")).otherwise(F.try_divide("overall_prop", total))
    return proportion.select("grp", "word", share.alias("share"))
