"""Nearest words by bounded sums, and numbers and ranks over ranges, against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from textpulse.operators import distance, nearest, ordinals


def corpus(seed=4):
    """Counts of terms in documents of very different lengths, some terms everywhere, some together in one document only."""
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i:03d}" for i in range(150)]
    rows = []
    for d in range(60):
        size = rng.choice((2, 4, 6, 25, 60))
        words = {rng.choice(common) for _ in range(3)} | {rng.choice(rare) for _ in range(size)}
        rows += [(d, "gh"[d % 3 == 0], w, rng.randrange(1, 5)) for w in words]
    return rows


def brute_cosine(rows):
    docs, norms = {}, {}
    for d, g, t, n in rows:
        docs.setdefault((d, g), {})[t] = n
        norms[g, t] = norms.get((g, t), 0) + n * n
    sums = {}
    for (_, g), cells in docs.items():
        for a, b in itertools.permutations(cells, 2):
            sums[g, a, b] = sums.get((g, a, b), 0) + cells[a] * cells[b]
    return {k: 1 - s / math.sqrt(norms[k[0], k[1]] * norms[k[0], k[2]]) for k, s in sums.items()}


@pytest.mark.parametrize("n, stages", [(5, (4, 10)), (20, (8, 30, 50)), (400, (4,)), (5, ())])
def test_nearest_words_are_those_of_the_full_table(spark, rows, n, stages):
    counts = corpus()
    table = spark.createDataFrame(counts, "doc_id long, grp string, term string, tf long").persist()
    vocab = table.select("term").distinct()
    chosen = vocab.where(F.col("term").isin(["c0", "c7", *(f"r{i:03d}" for i in range(0, 150, 9))]))
    got = nearest.nearest_cosine(table, chosen, n, stages).persist()
    want = brute_cosine(counts)
    kept = {(r.grp, r.term, r.other): r.dist for r in got.collect()}
    # What can matter is there with its exact value; what was dropped midway has no place among the nearest.
    near = distance.term_nearest(got, vocab, table.select("grp").distinct(), n, chosen=chosen)
    asked = {r.term for r in chosen.collect()}
    full = spark.createDataFrame([(*k, max(v, 0.0)) for k, v in want.items() if k[1] in asked], "grp string, term string, other string, dist double")
    assert rows(near) == rows(distance.term_nearest(full, vocab, table.select("grp").distinct(), n, chosen=chosen))
    assert all(v >= want[k] - 1e-9 for k, v in kept.items())


def test_a_long_document_forms_only_pairs_that_can_be_near(spark):
    short = [(d, "g", f"c{i}", 1 + (d + i) % 3) for d in range(40) for i in range(6)]
    long = [(99, "g", t, 1) for t in ("c0", *(f"r{i:03d}" for i in range(300)))]
    table = spark.createDataFrame(short + long, "doc_id long, grp string, term string, tf long").persist()
    chosen = spark.createDataFrame([("c0",), ("r007",)], "term string")
    got = nearest.nearest_cosine(table, chosen, 3, (20,)).collect()
    want = brute_cosine(short + long)
    assert all(abs(r.dist - max(want[r.grp, r.term, r.other], 0)) < 1e-9 for r in got)
    close = sorted((d, o) for (_, t, o), d in want.items() if t == "c0")[:3]
    assert {o for _, o in close} <= {r.other for r in got if r.term == "c0"} <= {f"c{i}" for i in range(1, 6)}  # none of the 300 that it met once
    assert len([r for r in got if r.term == "r007"]) == 300  # which are all near each other


def test_row_numbers_follow_the_order_over_ranges(spark):
    table = spark.range(1000).select(F.col("id"), F.hash("id").alias("v")).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    got = ordinals.row_numbers(table, "v", "id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    want = {i: n + 1 for n, (_, i) in enumerate(sorted((r.v, r.id) for r in got))}
    assert {r.id: r.row_number for r in got} == want
    assert ordinals.row_numbers(table.limit(0), "v").count() == 0


def test_average_ranks_with_ties_over_borders(spark, rows):
    rng = random.Random(2)
    data = [(rng.choice(("a", "b", None)), i, rng.choice((None, 1.0, 2.0, 2.5, 7.0))) for i in range(300)] + [("a", 1000 + i, 2.0) for i in range(300)]
    table = spark.createDataFrame(data, "grp string, id int, v double").repartition(6)
    got = {(r.grp, r.id): r["rank"] for r in ordinals.average_ranks(table, ["grp"], "v").collect()}
    assert len(got) == len(data)
    for g, i, v in data:
        values = [x for h, _, x in data if h == g and x is not None]
        above, same = sum(x > v for x in values) if v is not None else 0, sum(x == v for x in values)
        assert got[g, i] == (None if v is None else above + (same + 1) / 2)
