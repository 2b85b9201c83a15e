"""Do groups differ on a topic? Tukey's test, gated distance, densities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.functions.numeric import studentized_range_p, studentized_range_q

ALPHA = 0.05


def pair_statistics(scores: DataFrame) -> DataFrame:
    """Mean difference, Tukey-Kramer standard error and statistic of all pairs g1 < g2 per topic.

    One combinable aggregate over the scores; everything after it works on one row per (topic, group).
    """
    groups = scores.where(F.col("score").isNotNull()).groupBy("topic_id", "grp").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.var_samp("score").alias("var"))
    pooled = groups.groupBy("topic_id").agg(
        F.count("*").alias("k"), (F.sum("n") - F.count("*")).alias("df"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ss"))
    one = groups.select("topic_id", F.col("grp").alias("g1"), F.col("n").alias("n1"), F.col("mean").alias("m1"))
    two = groups.select("topic_id", F.col("grp").alias("g2"), F.col("n").alias("n2"), F.col("mean").alias("m2"))
    pairs = one.join(two, "topic_id").where("g1 < g2").join(pooled, "topic_id")
    se = F.sqrt(F.try_divide(F.col("ss"), F.col("df")) / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    return pairs.select("topic_id", "g1", "g2", (F.col("m2") - F.col("m1")).alias("meandiff"), se.alias("se"),
                        "k", "df").withColumn("q", F.try_divide(F.abs("meandiff"), F.col("se")))


def topic_group_diff(scores: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``pair_statistics`` with adjusted p-value, confidence interval and verdict."""
    critical = studentized_range_q(F.lit(alpha), F.col("k").cast("double"), F.col("df").cast("double"))
    tested = pair_statistics(scores).withColumn("crit", critical).withColumn(
        "p_adj", studentized_range_p(F.col("q"), F.col("k").cast("double"), F.col("df").cast("double")))
    return tested.select(
        "topic_id", "g1", "g2", "meandiff", "se", "q", "p_adj",
        (F.col("meandiff") - F.col("crit") * F.col("se")).alias("lower"),
        (F.col("meandiff") + F.col("crit") * F.col("se")).alias("upper"),
        F.coalesce(F.col("q") > F.col("crit"), F.lit(False)).alias("reject"))


def topic_group_distance(diff: DataFrame, topics: DataFrame) -> DataFrame:
    """Absolute mean difference, 0 unless significant, averaged per pair and scaled by the topic's sigma."""
    gated = F.when(F.col("reject"), F.abs("meandiff")).otherwise(0.0)
    per_pair = diff.groupBy("topic_id", "g1", "g2").agg(F.avg(gated).alias("_d"))
    return per_pair.join(topics.select("topic_id", "sigma"), "topic_id").select(
        "topic_id", "g1", "g2", (F.col("_d") * F.col("sigma")).alias("dist"))


def score_density(scores: DataFrame, bins: int = 40, value: str = "score", grp: str = "grp") -> DataFrame:
    """Histogram density per group on one grid of ``bins`` equal steps over the whole range of the score."""
    limits = scores.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    lo, hi = limits["lo"], limits["hi"]
    step = F.when(hi > lo, (hi - lo) / bins).otherwise(1.0)
    place = F.least(F.floor((F.col(value) - lo) / step), F.lit(bins - 1)).cast("int")
    counted = scores.where(F.col(value).isNotNull()).select(grp, place.alias("bin"), step.alias("_step"))
    per_bin = counted.groupBy(grp, "bin").agg(F.count("*").alias("_n"), F.first("_step").alias("_step"))
    total = per_bin.groupBy(grp).agg(F.sum("_n").alias("_total"))
    return per_bin.join(total, grp).select(grp, "bin", (F.col("_n") / F.col("_total") / F.col("_step")).alias("density"))


MOMENTS = 16  # with boxes one bandwidth wide a kernel is off by less than 0.5**16 / sqrt(16!) of its height, 4e-12
REACH = 12.0  # bandwidths beyond which a kernel is below 1e-31 of its height


def kernel_density(scores: DataFrame, points: int = 40, value: str = "score", grp: str = "grp",
                   factor: float = 0.9) -> DataFrame:
    """Gaussian kernel estimate per group at ``points`` places over the whole range of the score.

    Bandwidth ``factor * sd * n ** (-1/5)`` per group. A fast Gauss transform: scores fall into boxes one bandwidth wide, and a
    box keeps the sums of the powers of its scores' places in it. They weigh the Hermite polynomials that make up all of its
    kernels at any point, so what follows the scan has a row a task, group and box, however many points are asked for.
    """
    limits = scores.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    lo, hi = limits["lo"].cast("double"), limits["hi"].cast("double")
    known = scores.where(F.col(value).isNotNull()).select(grp, F.col(value).cast("double").alias("_y"))
    stats = known.groupBy(grp).agg(F.count("*").alias("n"), F.stddev_samp("_y").alias("sd"))
    stats = stats.where(F.col("sd") > 0).withColumn("h", factor * F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    placed = known.join(stats, grp).withColumn("_at", (F.col("_y") - lo) / F.col("h")).withColumn("box", F.floor("_at"))
    placed = placed.select(grp, "n", "h", "box", (F.col("_at") - F.col("box") - 0.5).alias("_s"))
    sums = [F.sum(F.pow("_s", F.lit(float(p)))) / math.factorial(p) for p in range(MOMENTS)]
    boxes = placed.groupBy(grp, "n", "h", "box").agg(F.array(*sums).alias("_m"))
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    rows = boxes.select(grp, "n", "h", "box", "_m", lo.alias("_lo"), hi.alias("_hi"), F.explode(steps).alias("point"))
    rows = rows.withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / (points - 1))
    rows = rows.withColumn("_t", (F.col("x") - F.col("_lo")) / F.col("h") - F.col("box") - 0.5)
    # He(p + 1) = t He(p) - p He(p - 1), by a fold over the moments.
    start = F.struct(F.lit(0.0).alias("before"), F.lit(1.0).alias("he"), F.lit(0.0).alias("p"), F.lit(0.0).alias("total"))
    series = F.aggregate("_m", start, lambda a, m: F.struct(
        a["he"].alias("before"), (F.col("_t") * a["he"] - a["p"] * a["before"]).alias("he"), (a["p"] + 1).alias("p"),
        (a["total"] + m * a["he"]).alias("total")), lambda a: a["total"])
    kernels = F.when(F.abs("_t") < REACH, F.exp(-F.col("_t") * F.col("_t") / 2) * series).otherwise(0.0)
    scaled = kernels / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return rows.groupBy(grp, "point").agg(F.first("x").alias("x"), F.sum(scaled).alias("density"))
