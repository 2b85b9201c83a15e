"""Nearest words of chosen terms over documents of any length, without the table of all pairs (A5, K1).

The cosine of two terms is a sum over documents. Documents are taken in stages, short ones first, where a pair is cheap. A term's
norm over the documents of a stage and all later ones bounds what these can still add: no more than the product of the two
terms' norms. After each stage a term knows the ``n``-th largest of its sums so far, which its ``n``-th nearest word cannot
fall below. In later stages, where one document may hold tens of thousands of terms, a pair is formed only if it may still
reach that: a new one if the product of the norms does, a known one if its sum and the product do. The others are dropped for good,
since bounds only fall and thresholds only rise. What is left at the end has its exact sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpulse.operators.distance import NEAREST
from textpulse.session import stored

STAGES = (128, 512, 2048)  # distinct terms of a document at which the next stage begins
SLACK = 1e-7  # distances are compared at nine digits


def staged_cells(counts: DataFrame, stages: tuple[int, ...] = STAGES) -> tuple[DataFrame, DataFrame]:
    """Written tables ``(doc_id, grp, term, x, stage, rest)``, counts over the term's norm in the group, and ``(grp, term, rest)``,
    its norms from each stage on. ``counts`` holds (doc_id, grp, term, tf).
    """
    sizes = counts.groupBy("doc_id").agg(F.count("*").alias("_n"))
    stage = sum(((F.col("_n") >= s).cast("int") for s in stages), F.lit(0))
    placed = counts.join(sizes.select("doc_id", stage.alias("stage")), "doc_id").select("doc_id", "grp", "term", F.col("tf").cast("double").alias("tf"), "stage")
    placed = stored(placed, "staged")
    square = F.col("tf") * F.col("tf")
    norms = placed.groupBy("grp", "term").agg(F.array(*(
        F.sqrt(F.coalesce(F.sum(F.when(F.col("stage") >= i, square)), F.lit(0.0))) for i in range(len(stages) + 1))).alias("_norms"))
    whole = F.get("_norms", F.lit(0))
    rests = stored(norms.select("grp", "term", whole.alias("norm"), F.transform("_norms", lambda v: v / whole).alias("rest")), "rests")
    cells = placed.join(rests, ["grp", "term"]).select("doc_id", "grp", "term", (F.col("tf") / F.col("norm")).alias("x"), "stage", "rest")
    return stored(cells, "cells"), rests


def nearest_sums(cells: DataFrame, rests: DataFrame, chosen: DataFrame, n: int = NEAREST, stages: int = len(STAGES) + 1) -> DataFrame:
    """``(grp, term, other, s)`` with the exact cosines of all pairs that can be among the ``n`` largest of a chosen term.

    The tables are those of ``staged_cells``. Terms are different, and pairs share a document.
    """
    asked = stored(cells.join(chosen.select("term"), "term", "left_semi"), "asked")
    known = None
    for i in range(stages):
        here = F.get("rest", F.lit(i))
        left = asked.where(F.col("stage") == i).select("doc_id", "grp", "term", "x", here.alias("r"))
        right = cells.where(F.col("stage") == i).select("doc_id", F.col("term").alias("other"), F.col("x").alias("y"), here.alias("q"))
        product = (F.col("x") * F.col("y")).alias("s")
        if known is None:
            sums = left.join(right, "doc_id").where("term <> other").select("grp", "term", "other", product)
        else:
            floor = _floor(known, n)
            left = left.join(floor, "term", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
            new = left.join(right, (left["doc_id"] == right["doc_id"]) & (F.col("term") != F.col("other")) & (F.col("r") * F.col("q") >= F.col("floor")))
            # A known pair that the norms alone do not admit meets in the documents of its chosen term.
            reaching = stored(_reaching(known, floor, rests, i), "reaching")
            held = reaching.where("bound < floor").select("grp", "term", "other")
            old = left.join(held, ["grp", "term"]).join(right, ["doc_id", "other"])
            sums = new.select("grp", "term", "other", product).unionByName(old.select("grp", "term", "other", product))
            sums = sums.unionByName(reaching.select("grp", "term", "other", "s"))
        known = stored(sums.groupBy("grp", "term", "other").agg(F.sum("s").alias("s")), "nearest-sums")
    return known


def _floor(known: DataFrame, n: int) -> DataFrame:
    """The ``n``-th largest sum of each term with as many, less what rounding may take away."""
    order = Window.partitionBy("term").orderBy(F.desc("s"))
    return known.select("term", "s").withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).groupBy("term").agg(
        F.count("*").alias("_n"), F.min("s").alias("_s")).where(F.col("_n") == n).select("term", (F.col("_s") - SLACK).alias("floor"))


def _reaching(known: DataFrame, floor: DataFrame, rests: DataFrame, stage: int) -> DataFrame:
    """Known pairs whose sum and bound reach the floor, with the bound."""
    rest = rests.select("grp", "term", F.get("rest", F.lit(stage)).alias("r"))
    rows = known.join(floor, "term", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    rows = rows.join(rest, ["grp", "term"]).join(rest.toDF("grp", "other", "q"), ["grp", "other"])
    return rows.withColumn("bound", F.col("r") * F.col("q")).where(F.col("s") + F.col("bound") >= F.col("floor"))


def nearest_cosine(counts: DataFrame, chosen: DataFrame, n: int = NEAREST, stages: tuple[int, ...] = STAGES) -> DataFrame:
    """``term_cosine`` of chosen terms with those words only that can be among their ``n`` nearest."""
    sums = nearest_sums(*staged_cells(counts, stages), chosen, n, len(stages) + 1)
    return sums.select("grp", "term", "other", F.least(F.greatest(1 - F.col("s"), F.lit(0.0)), F.lit(2.0)).alias("dist"))
