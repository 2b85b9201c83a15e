"""Mixing sources to target weights: temperature, bisected exponent, block permutations under a token budget.

Weights are source token shares raised to an exponent and normalised: 1 keeps the shares, 0 makes sources equal. Entropy
falls and the repetition of the scarcest source shrinks as the exponent grows, so a bisection finds the exponent that meets
an entropy target, or the smallest one within a repetition limit. The default target lies halfway between the entropy of the plain
shares and the largest one, so it follows the data and is met by a bisection unless all sources are equal. Each pass over the table of source totals evaluates the
15 exponents of four halvings at once; totals stay in Spark, however many sources there are.

A source's budget is its weight times the token budget. It is spent in whole passes over the source and a part of one more.
A pass is a permutation of blocks: documents fall into blocks of about ``block_tokens`` by a hash of their key, and each pass
orders blocks by another hash. The partial pass takes blocks in that order while they fit; of the block that does not fit
whole, documents are taken in hash order while they fit. Block totals are summed before anything is ordered, and a source
has at most ``MAX_BLOCKS`` blocks, so a source with a third of all rows is spread over that many groups.

With ``budget=None`` the budget is the smallest that gives every source one whole pass, so that no document is lost and only
scarcer sources repeat.

Defined results: a null source is a source of its own; documents without words (null and empty texts) count no tokens, are in
every pass and cost nothing; a source without tokens has weight 0 and one pass; repeated rows count and are drawn like other
documents (the order of rows with equal keys follows their text hash, rows equal in that too are taken together); an empty
table has no rows; other columns are kept whatever their names, columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse.llm.tables import stored

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_TOKENS = 1 << 16
MAX_BLOCKS = 4096
HALVINGS, PASSES = 4, 8
RESULTS = ["n_tokens", "weight", "passes", "copies", "block", "place"]


def with_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.drop(*RESULTS).withColumn("n_tokens", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint"))


def source_totals(docs: DataFrame, source: str = "source") -> DataFrame:
    """``(source, tokens)``; combined before the shuffle, so a hot source is one row a task."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum("n_tokens").alias("tokens"))


@dataclass(frozen=True)
class Target:
    """One of: the entropy as a share of its largest value; the entropy as a share of the way from that of the plain shares to the
    largest; the most passes over any source relative to the least repeated."""

    entropy: float | None = None
    gap: float | None = None
    max_repeat: float | None = None


def exponent(totals: DataFrame, target: Target) -> float:
    """The exponent between 0 and 1 that meets the target; 1 if the plain shares already do, 0 if nothing does."""
    held = totals.where("tokens > 0")
    whole = held.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not whole["n"] or whole["n"] == 1:
        return 1.0
    share = F.col("tokens") / F.lit(float(whole["t"]))
    flat = target.max_repeat is None
    if flat:
        most = log(whole["n"])
        plain = held.agg(-F.sum(share * F.log(share))).first()[0]
        wanted = target.entropy * most if target.gap is None else plain + target.gap * (most - plain)

    def measured(exponents: list[float]) -> list[bool]:
        """Whether each exponent is flat enough (entropy) or not too flat (repetition)."""
        cells = []
        for i, a in enumerate(exponents):
            p = F.pow(share, F.lit(a))
            cells += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log(p)).alias(f"l{i}"),
                      F.max(p / share).alias(f"hi{i}"), F.min(p / share).alias(f"lo{i}")]
        row = held.agg(*cells).first()
        out = []
        for i in range(len(exponents)):
            if flat:
                entropy = log(row[f"z{i}"]) - row[f"l{i}"] / row[f"z{i}"]
                out.append(entropy >= wanted - 1e-12)
            else:
                out.append(row[f"hi{i}"] / row[f"lo{i}"] <= target.max_repeat + 1e-12)
        return out

    # Entropy: the largest exponent that is flat enough. Repetition: the smallest that repeats no more than allowed.
    low, high = 0.0, 1.0
    at_low, at_high = measured([low, high])
    if flat and at_high:
        return high
    if not flat and at_low:
        return low
    if not (at_low if flat else at_high):
        return low if flat else high
    for _ in range(PASSES):
        step = (high - low) / (1 << HALVINGS)
        points = [low + step * i for i in range(1, 1 << HALVINGS)]
        fits = measured(points)
        kept = sum(fits)  # the condition holds below (entropy) or above (repetition) one point
        if flat:
            low, high = ([low, *points])[kept], ([*points, high])[kept]
        else:
            low, high = ([low, *points])[len(points) - kept], ([*points, high])[len(points) - kept]
    return low if flat else high


def weights(totals: DataFrame, alpha: float, budget: float | None = None) -> DataFrame:
    """``(source, tokens, weight, passes)``: passes are how often the source's tokens fit into its budget."""
    whole = totals.where("tokens > 0").agg(F.sum("tokens").alias("t"), F.sum(F.pow("tokens", F.lit(alpha))).alias("z")).first()
    if not whole["t"]:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("passes"))
    weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(alpha)) / F.lit(float(whole["z"]))).otherwise(0.0)
    out = totals.select("source", "tokens", weight.alias("weight"))
    if budget is None:
        budget = out.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
    passes = F.round(F.col("weight") * F.lit(float(budget)) / F.col("tokens"), 9)
    return out.withColumn("passes", F.coalesce(F.when(F.col("tokens") > 0, passes), F.lit(1.0)))


def _order(*parts: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def realise(docs: DataFrame, plan: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
            block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """Adds ``weight``, ``passes`` (of the source), ``copies`` (of the document in the mixture), ``block`` and the block's ``place``
    in the order of the first pass over its source, from 1.

    ``docs`` has ``n_tokens``. Rows of a source that the partial pass does not reach keep the copies of its whole passes.
    """
    blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens))).cast("int")
    plan = plan.select(F.col("source").alias("_source"), "weight", "passes", "tokens", blocks.alias("_blocks"),
                       F.floor("passes").cast("bigint").alias("_full"))
    plan = plan.withColumn("_left", F.floor((F.col("passes") - F.col("_full")) * F.col("tokens")).cast("bigint"))
    # Whole rows travel in one struct, so that no column of theirs can clash with a working one.
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"), F.col(source).alias("_of"), "n_tokens",
                       _order(F.col(key), F.col(text), seed=seed).alias("_doc"))
    placed = rows.join(plan, F.col("_of").eqNullSafe(F.col("_source"))).drop("_of").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_doc")), F.col("_blocks")).cast("int"))
    every = plan.select("_source", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
    first = Window.partitionBy("_source").orderBy(_order(F.col("_source"), F.col("block"), F.lit(0).cast("bigint"), seed=seed + 2), "block")
    places = every.select(F.col("_source").alias("_s"), F.col("block").alias("_b"), F.row_number().over(first).alias("place"))
    # Block totals of sources with a partial pass, in the order of that pass.
    sums = placed.where("_left > 0").groupBy("_source", "block").agg(
        F.sum("n_tokens").alias("_sum"), F.first("_left").alias("_left"), F.first("_full").alias("_full"))
    turn = Window.partitionBy("_source").orderBy(_order(F.col("_source"), F.col("block"), F.col("_full"), seed=seed + 2), "block")
    ordered = sums.withColumn("_after", F.sum("_sum").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("_after") <= F.col("_left")
    cut = ~fits & (F.col("_after") - F.col("_sum") < F.col("_left"))
    ordered = ordered.select("_source", "block", fits.alias("_fits"), F.when(cut, F.col("_left") - F.col("_after") + F.col("_sum")).alias("_room"))
    # In the one block a source that fits only in part, documents are taken in hash order.
    ordered = stored(ordered, "mixing-blocks")  # at most MAX_BLOCKS rows a source, so its size is known from here on
    room = ordered.where("_room IS NOT NULL").select(F.col("_source").alias("_s"), F.col("block").alias("_b"), "_room")
    inner = placed.select("_source", "block", "_doc", "n_tokens").join(
        room, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    # How far the hash order of documents gets: the first hash that no longer fits.
    line = Window.partitionBy("_source", "block").orderBy("_doc").rangeBetween(Window.unboundedPreceding, 0)
    stop = inner.withColumn("_sofar", F.sum("n_tokens").over(line)).where("_sofar > _room").groupBy("_source", "block").agg(
        F.min("_doc").alias("_stop"))
    stop = stop.withColumnsRenamed({"_source": "_s", "block": "_b"})
    marks = stored(ordered.join(stop, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left").select(
        F.col("_source").alias("_s"), F.col("block").alias("_b"), "_fits", "_room", "_stop"), "mixing-marks")
    out = placed.join(marks, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left").drop("_s", "_b")
    out = out.join(stored(places, "mixing-places"), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    extra = F.coalesce(F.col("_fits"), F.lit(False)) | (F.col("_room").isNotNull() & (F.coalesce(F.col("_doc") < F.col("_stop"), F.lit(True))))
    return out.select("_row.*", "weight", "passes", (F.col("_full") + extra.cast("bigint")).alias("copies"), "block", "place")


def mix(docs: DataFrame, target: Target = Target(gap=0.5), budget: float | None = None, key: str = "doc_id",
        source: str = "source", text: str = "text", **realised) -> DataFrame:
    """``docs`` with ``n_tokens``, ``weight``, ``passes``, ``copies``, ``block`` and ``place``. Documents with 0 copies stay listed."""
    counted = with_tokens(docs, text)
    totals = stored(source_totals(counted, source), "source-totals")
    plan = weights(totals, exponent(totals, target), budget)
    return realise(counted, stored(plan, "source-weights"), key, source, text, **realised)


def sequence(mixed: DataFrame, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """The mixture spelled out: a row a copy, with ``pass`` and ``position``, by which training reads it in permuted blocks."""
    rows = mixed.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return rows.withColumn("position", _order(F.col("block"), F.col("pass"), seed=seed + 2)).drop("copies")
