"""Which terms lie near a term, and how far groups differ in its use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpulse.functions.numeric import tie_safe
from textpulse.operators.ordinals import row_numbers
from textpulse.operators.pairs import cell_sums, mirrored
from textpulse.operators.sizes import small
from textpulse.session import stored

NEAREST = 60


def ordered_ids(vocab: DataFrame) -> DataFrame:
    """``(term, term_id)`` with ids from 0 on in the order of the terms, for a vocabulary of any size.

    The sort is distributed; ids are written once, so that every reader sees the same ones.
    """
    numbered = row_numbers(vocab.select("term"), "term", name="term_id")
    return stored(numbered.select("term", (F.col("term_id") - 1).alias("term_id")), "term-ids")


def term_cosine(counts: DataFrame, vocab: DataFrame, vocab_rows: int | None = None, chosen: DataFrame | None = None,
                cells: DataFrame | None = None) -> DataFrame:
    """Cosine distance per group of all pairs of *different* terms that share a document.

    ``counts`` holds (doc_id, grp, term, tf) of the vocabulary's terms and is read twice: store it. Pairs that share
    no document are at distance 1 and are not stored; a term is at distance 0 from itself. ``vocab_rows`` is the
    measured vocabulary size, if known: it decides whether term numbers travel by broadcast or by a shuffle join.
    ``chosen`` restricts ``term`` (a point read), and then only documents with a chosen term are paired. ``cells``, the same
    counts with a row (doc_id, grp, cells) a document, spare the join of those documents' rows; with them rows that share their
    ``doc_id`` count as one document, and those without one as none.

    Without ``cells`` counts are divided by their norm before they are multiplied, so a sum of products is the cosine and the table of pairs is
    shuffled once, by pair, when a task has added those of its documents.
    """
    apart = F.least(F.greatest(1 - F.col("s"), F.lit(0.0)), F.lit(2.0)).alias("dist")
    if chosen is not None and cells is not None:
        return _chosen_cosine(counts, cells, vocab, vocab_rows, chosen).select("grp", "term", "other", apart)
    if cells is not None:
        return _all_cosine(counts, cells, vocab, vocab_rows).select("grp", "term", "other", apart)
    norms = counts.groupBy("grp", "term").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    if chosen is not None:
        sums = _met(counts.join(chosen.select("term"), "term", "left_semi"), counts)
        sums = sums.join(norms.toDF("grp", "term", "na"), ["grp", "term"]).join(norms.toDF("grp", "other", "nb"), ["grp", "other"])
        return sums.withColumn("s", F.col("s") / (F.col("na") * F.col("nb"))).select("grp", "term", "other", apart)
    ids = ordered_ids(vocab)
    unit = counts.join(norms, ["grp", "term"]).join(small(ids, vocab_rows), "term").select(
        "doc_id", "grp", "term_id", (F.col("tf") / F.col("norm")).alias("x"))
    pairs = mirrored(cell_sums(unit, "x", n_terms=ids.count()))
    return (pairs.join(small(ids.toDF("term", "a"), vocab_rows), "a").join(small(ids.toDF("other", "b"), vocab_rows), "b")
            .select("grp", "term", "other", apart))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sums of products of the rows of ``left`` with those of other terms of the same ``doc_id``."""
    left = left.select("doc_id", "grp", "term", F.col("tf").alias("x"))
    met = left.join(right.select("doc_id", F.col("term").alias("other"), F.col("tf").alias("y")), "doc_id").where("term <> other")
    return met.groupBy("grp", "term", "other").agg(F.sum(F.col("x") * F.col("y")).alias("s"))


def _repeated(cells: DataFrame) -> DataFrame:
    """``(doc_id)`` of the documents with more than one row."""
    return stored(cells.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated")


def _all_cosine(counts: DataFrame, cells: DataFrame, vocab: DataFrame, vocab_rows: int | None) -> DataFrame:
    """``(grp, term, other, s)`` of all pairs of terms, as ``_chosen_cosine`` gives them for each term.

    Products of counts are whole numbers until the norms, which come with the terms' names, divide their sums. A pair is formed,
    shuffled and named once; its other order is added last. Only the pairs of repeated documents have orders of their own.
    """
    again, ids = _repeated(cells), ordered_ids(vocab)
    repeated = again.count()
    numbered = counts.join(small(ids, vocab_rows), "term")
    norms = counts.where("grp IS NOT NULL").groupBy("grp", "term").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    norms = stored(norms.join(small(ids, vocab_rows), "term").select("grp", "term", "term_id", "norm"), "term-norms")
    n_norms = norms.count()
    alone = numbered.where("doc_id IS NOT NULL")
    alone = alone.join(small(again, repeated), "doc_id", "left_anti") if repeated else alone
    sums = cell_sums(alone.select("doc_id", "grp", "term_id", "tf"), "tf", n_terms=ids.count())
    if repeated:
        those = numbered.join(small(again, repeated), "doc_id", "left_semi").select("doc_id", "grp", F.col("term_id").alias("term"), "tf")
        more = _met(those, those).where("grp IS NOT NULL").select("grp", F.col("term").alias("a"), F.col("other").alias("b"), "s")
        sums = mirrored(sums).unionByName(more).groupBy("grp", "a", "b").agg(F.sum("s").alias("s"))
    named = sums.join(small(norms.toDF("grp", "term", "a", "na"), n_norms), ["grp", "a"])
    named = named.join(small(norms.toDF("grp", "other", "b", "nb"), n_norms), ["grp", "b"])
    named = named.select("grp", "term", "other", (F.col("s") / (F.col("na") * F.col("nb"))).alias("s"))
    if repeated:
        return named
    both = F.array(F.struct("term", "other"), F.struct(F.col("other").alias("term"), F.col("term").alias("other")))
    return named.select("grp", F.inline(both), "s")


def _chosen_cosine(counts: DataFrame, cells: DataFrame, vocab: DataFrame, vocab_rows: int | None, chosen: DataFrame) -> DataFrame:
    """``(grp, term, other, s)`` of the chosen terms from a row a document: sums of squares and of products in one aggregate.

    The chosen terms' counts are picked inside the document's row, a number for each, so nothing is joined by document. Only rows
    that share their ``doc_id`` are: they count as one document, and those without one as none.
    """
    asked = sorted(r["term"] for r in chosen.select("term").collect())  # a point read: a few terms
    if not asked:
        return cells.sparkSession.createDataFrame([], "grp string, term string, other string, s double")
    again = _repeated(cells)
    repeated = again.count()
    shared = small(again.withColumn("_again", F.lit(True)), repeated)
    cells = cells.join(shared, "doc_id", "left") if repeated else cells.withColumn("_again", F.lit(None).cast("boolean"))
    alone = F.col("doc_id").isNotNull() & F.col("_again").isNull()
    count = lambda t: F.when(alone, F.get(F.filter("cells", lambda c: c["term"] == t), F.lit(0))["tf"])
    of = [F.coalesce(count(t), F.lit(0)).alias(f"_x{i}") for i, t in enumerate(asked)]
    rows = cells.where("grp IS NOT NULL").select("grp", *of, "cells")
    rows = rows.select("grp", *(f"_x{i}" for i in range(len(asked))), F.inline("cells").alias("other", "y"))
    sums = rows.groupBy("grp", "other").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("nb"), *(
        F.sum(F.col(f"_x{i}") * F.col("y")).alias(f"_s{i}") for i in range(len(asked))))
    sums = sums.join(small(vocab.select(F.col("term").alias("other")), vocab_rows), "other", "left_semi")
    each = sums.select("grp", "other", "nb", F.inline(F.array(*(
        F.struct(F.lit(t).alias("term"), F.col(f"_s{i}").alias("s")) for i, t in enumerate(asked)))))
    own = each.where("term = other").select("grp", "term", F.col("nb").alias("na"))
    if repeated:
        those = counts.join(small(again, repeated), "doc_id", "left_semi")
        more = _met(those.where(F.col("term").isin(asked)), those).join(each.select("grp", "other", "nb").distinct(), ["grp", "other"])
        each = each.unionByName(more).groupBy("grp", "term", "other").agg(F.max("nb").alias("nb"), F.sum("s").alias("s"))
    met = each.where("term <> other AND s > 0").join(own, ["grp", "term"])
    return met.select("grp", "term", "other", (F.col("s") / (F.col("na") * F.col("nb"))).alias("s"))


def term_nearest(cosine: DataFrame, vocab: DataFrame, groups: DataFrame, n: int = NEAREST,
                 per_group: bool = False, chosen: DataFrame | None = None) -> DataFrame:
    """The ``n`` nearest (group, word) entries per term, over all groups (or per group), self entries included.

    Ties go by group, then word. The closest ``n`` stored pairs are picked first, by a limit that runs before the
    shuffle. A term with fewer of them is filled with entries at distance 1. Those come in (group, word) order, so the
    first ``2 n`` pairs of that order hold enough that are not among the closer ones, and the full set of absent pairs
    is never built. ``chosen`` are the terms asked for, if not all of the vocabulary.
    """
    part = ["term", "grp"] if per_group else ["term"]
    place = F.row_number().over(Window.partitionBy(*part).orderBy("dist", "grp", "word"))
    columns = ["term", "grp", "word", "dist"]

    def nearest(entries: DataFrame) -> DataFrame:
        return entries.withColumn("_place", place).where(F.col("_place") <= n).select(columns)

    names, words = groups.select("grp").distinct(), vocab.select("term").distinct()
    # Self entries are at distance 0 in every group; globally only the first n groups can take part.
    selves_in = names if per_group else names.orderBy("grp").limit(n)
    asked = words if chosen is None else words.join(chosen.select("term"), "term", "left_semi")
    selves = asked.select("term", F.explode(selves_in.agg(F.collect_set("grp")).scalar()).alias("grp"))
    selves = selves.select("term", "grp", F.col("term").alias("word"), F.lit(0.0).alias("dist"))
    stored = cosine.select("term", "grp", F.col("other").alias("word"), tie_safe(F.col("dist")).alias("dist"))

    first_words = words.orderBy("term").limit(2 * n).agg(F.collect_list("term")).scalar()
    if per_group:
        slots = selves.select("term", "grp", F.explode(first_words).alias("word"))
    else:
        lead = names.orderBy("grp").limit(2 * n).select("grp", F.explode(first_words).alias("word"))
        lead = lead.orderBy("grp", "word").limit(2 * n).agg(F.collect_list(F.struct("grp", "word"))).scalar()
        slots = asked.select("term", F.inline(lead))
    near = nearest(stored.where("dist < 1").unionByName(selves))
    filled = near.unionByName(slots.withColumn("dist", F.lit(1.0)))
    return nearest(filled.groupBy("term", "grp", "word").agg(F.min("dist").alias("dist")))


def group_distance(near: DataFrame, fill: float = 0.0) -> DataFrame:
    """Euclidean distance of all ordered pairs of groups per term, over the words retained for the term.

    A word missing in a group reads ``fill``. With shifted values ``d - fill`` the missing ones vanish, so only words
    that both groups retain are joined: |x - y|^2 = |x|^2 + |y|^2 - 2 xy. A term has at most n retained entries.
    """
    shifted = near.select("term", "grp", "word", (F.col("dist") - fill).alias("d"))
    norms = shifted.groupBy("term", "grp").agg(F.sum(F.col("d") * F.col("d")).alias("n"))
    left, right = shifted.toDF("term", "g1", "word", "d1"), shifted.toDF("term", "g2", "word", "d2")
    shared = left.join(right, ["term", "word"]).where("g1 < g2").groupBy("term", "g1", "g2").agg(
        F.sum(F.col("d1") * F.col("d2")).alias("xy"))
    n1, n2 = norms.toDF("term", "g1", "n1"), norms.toDF("term", "g2", "n2")
    once = n1.join(n2, "term").where("g1 <= g2").join(shared, ["term", "g1", "g2"], "left")
    square = F.greatest(F.col("n1") + F.col("n2") - 2 * F.coalesce("xy", F.lit(0.0)), F.lit(0.0))
    once = once.select("term", "g1", "g2", F.when(F.col("g1") == F.col("g2"), F.lit(0.0)).otherwise(
        F.sqrt(square)).alias("dist"))
    both = F.when(F.col("g1") == F.col("g2"), F.array(F.struct("g1", "g2"))).otherwise(
        F.array(F.struct("g1", "g2"), F.struct(F.col("g2").alias("g1"), F.col("g1").alias("g2"))))
    return once.select("term", F.inline(both), "dist")


def term_edges(near: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Bipartite edges group - word of each term's retained set, the term itself removed.

    Parity rule: the pivot behind the graph gives every retained group every retained word, absent ones at 0.
    """
    near = near if terms is None else near.join(terms.select("term"), "term", "left_semi")
    grps = near.select("term", "grp").distinct()
    words = near.where("word <> term").select("term", "word").distinct()
    full = grps.join(words, "term").join(near, ["term", "grp", "word"], "left")
    return full.select("term", "grp", "word", F.coalesce("dist", F.lit(0.0)).alias("dist"))


def node_join(edges: DataFrame) -> DataFrame:
    """Edges with attributes of both end nodes: number of edges and mean distance."""
    def nodes(side: str) -> DataFrame:
        return edges.groupBy("term", side).agg(
            F.count("*").alias(f"{side}_degree"), F.avg("dist").alias(f"{side}_mean"))

    return edges.join(nodes("grp"), ["term", "grp"]).join(nodes("word"), ["term", "word"])
