"""Row numbers and ranks over a whole table, or over groups of any size, without a task that sees a whole group.

A sorted table is written once; its partitions are ranges of the order. A range's rows know their place in it, and the counts of
the ranges, one row each, give the places of the ranges. Equal values may lie on both sides of a border: their first and last
numbers come from a combined aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpulse.session import stored

_PLACES = 33  # bits that monotonically_increasing_id gives to the place within a partition


def row_numbers(df: DataFrame, *order, name: str = "row_number") -> DataFrame:
    """Numbers from 1 in the given order, which should be total if numbers are to be repeatable; ``df`` is written."""
    numbered = stored(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "sorted")
    part = F.shiftright(name, _PLACES).alias("_part")
    # One row a range; the running sum over them is the only step that one task does.
    counts = numbered.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = numbered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    place = F.col(name) - F.shiftleft("_part", _PLACES)
    return joined.withColumn(name, F.col("_start") + place + 1).drop("_part", "_start")


def average_ranks(df: DataFrame, groups: list[str], value: str, name: str = "rank") -> DataFrame:
    """Rank of ``value`` in its group, highest first; equal values share the mean of their places, null has none."""
    group = F.struct(*groups) if groups else F.lit(0)
    known = row_numbers(df.where(F.col(value).isNotNull()), *groups, F.desc(value), name="_row").withColumn("_g", group)
    ties = known.groupBy("_g", F.col(value).alias("_v")).agg(F.min("_row").alias("_lo"), F.max("_row").alias("_hi"))
    firsts = ties.groupBy("_g").agg(F.min("_lo").alias("_first"))
    ranks = ties.join(firsts, "_g").select("_g", "_v", ((F.col("_lo") + F.col("_hi")) / 2 - F.col("_first") + 1).alias(name))
    ranked = known.withColumn("_v", F.col(value)).join(ranks, ["_g", "_v"])
    missing = df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double"))
    return ranked.select(*df.columns, name).unionByName(missing.select(*df.columns, name))
