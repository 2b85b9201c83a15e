"""Which terms co-vary with a term, per group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpulse.functions.numeric import tie_safe
from textpulse.operators.pairs import mirrored, number_terms, pair_sums_all, pair_sums_for
from textpulse.operators.sizes import small

# A variance this small relative to the raw second moment is rounding noise of a constant column.
CONSTANT = 1e-12
PARTS = 16  # of a group's terms, so that a single group does not end in a single task


def _numbered(weights: DataFrame, ids: DataFrame, vocab_rows: int | None) -> DataFrame:
    return weights.join(small(ids, vocab_rows), "term").select("doc_id", "grp", "term_id", "term", "w")


def term_moments(weights: DataFrame, docs: DataFrame, vocab: DataFrame, vocab_rows: int | None = None) -> DataFrame:
    """Per group, the terms whose weight varies over *all* documents of the group: ``(grp, term_id, term, n, sx, ss)``."""
    rows = _numbered(weights, number_terms(vocab.select("term")), vocab_rows)
    x = F.col("w")
    sums = rows.groupBy("grp", "term_id", "term").agg(F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    sizes = docs.groupBy("grp").agg(F.count("*").alias("n"))
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    return sums.join(sizes, "grp").select("grp", "term_id", "term", "n", "sx", spread.alias("ss"), "sxx").where(
        F.col("ss") > CONSTANT * F.col("n") * F.col("sxx")).drop("sxx")


def term_corr(weights: DataFrame, docs: DataFrame, vocab: DataFrame, chosen: DataFrame | None = None,
              vocab_rows: int | None = None, moments: DataFrame | None = None) -> DataFrame:
    """Pearson correlation over the documents of each group: ``(grp, term, other, corr)``, self included.

    A group in which ``term`` is constant has no rows; ``other`` appears if the pair is defined in some group, and
    reads 0 in the groups where it is not. ``chosen`` restricts ``term`` (a point read) and then only documents that
    contain a chosen term are paired. ``weights`` and ``moments``, one row per group and term
    (``term_moments``), are read more than once: persist or store them.

    Pairs that never share a document have a correlation too, so the answer is dense: groups x terms x terms. It is unfolded
    only at the very end: the sums of products of a part of a group's terms meet the moments of all its terms, as matrices
    with a row per term of the part and a column per term, both no longer than the capped vocabulary.
    """
    ids = number_terms(vocab.select("term"))
    rows = _numbered(weights, ids, vocab_rows)
    varying = term_moments(weights, docs, vocab, vocab_rows) if moments is None else moments
    if chosen is None:
        wanted, sums = varying, mirrored(pair_sums_all(rows, "w"))
        asked = varying.withColumn("asked", F.lit(True))
    else:
        picked = ids.join(chosen.select("term"), "term", "left_semi").select("term_id")
        wanted = varying.join(small(picked, vocab_rows), "term_id", "left_semi")
        sums = pair_sums_for(rows, picked, "w")
        asked = varying.join(small(picked.withColumn("asked", F.lit(True)), vocab_rows), "term_id", "left")
    part = F.pmod("a", F.lit(PARTS)).cast("int")
    cells = sums.select(F.col("grp").alias("g"), part.alias("p"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "s")
    peers = asked.select("grp", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.col("term_id").cast("int").alias("t"),
                         "term", F.col("n").cast("double").alias("n"), "sx", "ss", F.coalesce("asked", F.lit(False)).alias("asked"))
    known = cells.groupBy("g", "p").cogroup(peers.groupBy("grp", "part")).applyInArrow(
        _correlate, "grp string, term string, other string, corr double")
    return known.unionByName(_undefined(wanted, varying, docs, ids))


def _correlate(cells: pa.Table, peers: pa.Table) -> pa.Table:
    """Correlations of the asked terms of one part of a group with all varying terms of the group."""
    schema = pa.schema([("grp", pa.string()), ("term", pa.string()), ("other", pa.string()), ("corr", pa.float64())])
    if not peers.num_rows:
        return schema.empty_table()
    peers = peers.sort_by("t").combine_chunks()
    column = {c: peers.column(c).to_numpy() for c in ("t", "n", "sx", "ss", "part", "asked")}
    t, names = column["t"], peers.column("term").combine_chunks()
    mine = np.flatnonzero(column["asked"] & (t % PARTS == column["part"]))
    products = np.zeros((len(mine), len(t)))
    if cells.num_rows and len(mine):
        a, b, s = (cells.column(c).to_numpy() for c in ("a", "b", "s"))
        i, j = np.searchsorted(t[mine], a), np.searchsorted(t, b)
        met = (i < len(mine)) & (j < len(t))
        met &= (t[mine][np.minimum(i, len(mine) - 1)] == a) & (t[np.minimum(j, len(t) - 1)] == b)
        products[i[met], j[met]] = s[met]
    r = (column["n"][mine, None] * products - column["sx"][mine, None] * column["sx"]) / np.sqrt(column["ss"][mine, None] * column["ss"])
    grp = pa.array([peers.column("grp")[0].as_py()], pa.string()).take(pa.array(np.zeros(r.size, np.int32)))
    return pa.Table.from_arrays([grp, names.take(pa.array(np.repeat(mine, len(t)))), names.take(pa.array(np.tile(np.arange(len(t)), len(mine)))),
                                 pa.array(np.clip(r, -1.0, 1.0).ravel())], schema=schema)  # rounding may leave a hair outside


def _undefined(wanted: DataFrame, varying: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Zero rows where ``other`` is constant in the group but the pair is defined in another group.

    The candidates are few when most terms vary in most groups, so they are made from the constant terms outwards.
    """
    one = wanted.select("grp", "term")
    two = varying.select("grp", F.col("term").alias("other"))
    terms = ids.agg(F.collect_list("term")).scalar()
    constant = docs.select("grp").distinct().select("grp", F.explode(terms).alias("other")).join(
        two, ["grp", "other"], "left_anti")
    missing = one.join(constant, "grp").select("grp", "term", "other")
    elsewhere = (missing.select("term", "other").distinct().join(one.toDF("g", "term"), "term")
                 .join(two.toDF("g", "other"), ["g", "other"], "left_semi").select("term", "other").distinct())
    return missing.join(elsewhere, ["term", "other"], "left_semi").select(
        "grp", "term", "other", F.lit(0.0).alias("corr"))


def word_correlations(corr: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` strongest per (term, group), from which the term itself is then removed."""
    order = Window.partitionBy("term", "grp").orderBy(F.desc(tie_safe(F.abs("corr"))), "other")
    ranked = corr.withColumn("_place", F.row_number().over(order))
    return ranked.where((F.col("_place") <= top) & (F.col("other") != F.col("term"))).drop("_place")
