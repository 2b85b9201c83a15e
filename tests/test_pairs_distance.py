import itertools

import numpy as np
import pandas as pd
import pytest

from textpulse.operators import assoc, distance, pairs, reshape

TERMS = ["t0", "t1", "t2", "t3", "t4"]


def _corpus(spark, seed=3, docs=24):
    """Random counts; t4 is the same in all documents of group b, t3 is absent from group c."""
    rng = np.random.default_rng(seed)
    grps = ["a", "b", "c"]
    table = pd.DataFrame(rng.integers(0, 3, (docs, 5)), columns=TERMS)
    table["grp"] = [grps[i % 3] for i in range(docs)]
    table.loc[table.grp == "b", "t4"] = 2
    table.loc[table.grp == "c", "t3"] = 0
    long = [(i, r.grp, t, float(r[t])) for i, r in table.iterrows() for t in TERMS if r[t]]
    rows = spark.createDataFrame(long, "doc_id long, grp string, term string, w double")
    keys = spark.createDataFrame([(i, r.grp) for i, r in table.iterrows()], "doc_id long, grp string")
    vocab = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return table, rows, keys, vocab


def _corr_by_pandas(table):
    """Stored matrices with nulls dropped, read back with 0 for the holes."""
    out = {}
    per_group = {g: part[TERMS].corr() for g, part in table.groupby("grp")}
    for t in TERMS:
        col = pd.DataFrame({g: m[t] for g, m in per_group.items()}).dropna(how="all").dropna(how="all", axis=1).fillna(0)
        for g, o in itertools.product(col.columns, col.index):
            out[g, t, o] = col.loc[o, g]
    return out


@pytest.mark.parametrize("chosen", [None, ["t0", "t3", "t4"]])
def test_correlation_matches_pandas(spark, chosen):
    table, rows, keys, vocab = _corpus(spark)
    want = {k: v for k, v in _corr_by_pandas(table).items() if chosen is None or k[1] in chosen}
    picked = None if chosen is None else spark.createDataFrame([(t,) for t in chosen], "term string")
    got = {(r.grp, r.term, r.other): r["corr"] for r in assoc.term_corr(rows, keys, vocab, picked).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert ("b", "t4", "t0") not in got and got["b", "t0", "t4"] == 0


def test_top_correlations_drop_self_after_the_cut(spark, rows):
    corr = spark.createDataFrame([("a", "x", "x", 1.0), ("a", "x", "n", -0.9), ("a", "x", "p", 0.5), ("a", "x", "q", 0.5)],
                                 "grp string, term string, other string, corr double")
    assert rows(assoc.word_correlations(corr, top=3).select("other")) == [("n",), ("p",)]


def _cosines(table):
    out = {}
    for g, part in table.groupby("grp"):
        x = part[TERMS].to_numpy(float)
        norm = np.linalg.norm(x, axis=0)
        for i, j in itertools.product(range(5), range(5)):
            whole = norm[i] * norm[j]
            out[g, TERMS[i], TERMS[j]] = 0.0 if i == j else 1 - x[:, i] @ x[:, j] / whole if whole else 1.0
    return out


def test_cosine_and_nearest_match_brute_force(spark):
    table, rows, keys, vocab = _corpus(spark)
    want = _cosines(table)
    cosine = distance.term_cosine(rows.withColumnRenamed("w", "tf"), vocab, 5).persist()
    got = {(r.grp, r.term, r.other): r.dist for r in cosine.collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    assert all(k in got or k[1] == k[2] or v == pytest.approx(1) for k, v in want.items())
    for n in (4, 9, 15, 40):
        near = distance.term_nearest(cosine, vocab, keys, n)
        seen = {t: sorted((round(r.dist, 9), r.grp, r.word) for r in part)
                for t, part in itertools.groupby(sorted(near.collect(), key=lambda r: r.term), key=lambda r: r.term)}
        for t in TERMS:
            full = sorted((round(v, 9), g, o) for (g, s, o), v in want.items() if s == t)
            assert seen[t] == full[:n]


def test_nearest_per_group(spark):
    table, rows, keys, vocab = _corpus(spark)
    near = distance.term_nearest(distance.term_cosine(rows.withColumnRenamed("w", "tf"), vocab), vocab, keys, 3, per_group=True)
    want = _cosines(table)
    got = near.collect()
    assert len(got) == 5 * 3 * 3
    for t, g in itertools.product(TERMS, "abc"):
        full = sorted((round(v, 9), o) for (h, s, o), v in want.items() if s == t and h == g)
        assert sorted((round(r.dist, 9), r.word) for r in got if r.term == t and r.grp == g) == full[:3]


NEAR = [("t", "a", "t", 0.0), ("t", "a", "u", 0.5), ("t", "b", "t", 0.0), ("t", "b", "v", 0.4), ("t", "c", "u", 0.2)]


@pytest.mark.parametrize("fill", [0.0, 1.0])
def test_group_distance_equals_pivot(spark, fill):
    near = spark.createDataFrame(NEAR, "term string, grp string, word string, dist double")
    wide = pd.DataFrame(NEAR, columns=["term", "grp", "word", "dist"]).pivot(index="grp", columns="word", values="dist").fillna(fill)
    got = {(r.g1, r.g2): r.dist for r in distance.group_distance(near, fill).collect()}
    assert len(got) == 9
    for x, y in itertools.product("abc", "abc"):
        assert got[x, y] == pytest.approx(np.linalg.norm(wide.loc[x] - wide.loc[y]), abs=1e-7)


def test_edges_nodes_and_vector(spark, rows):
    near = spark.createDataFrame(NEAR, "term string, grp string, word string, dist double")
    edges = distance.term_edges(near)
    assert rows(edges) == [("t", g, w, d) for g, w, d in
                           [("a", "u", .5), ("a", "v", .0), ("b", "u", .0), ("b", "v", .4), ("c", "u", .2), ("c", "v", .0)]]
    nodes = distance.node_join(edges).collect()
    assert all(r.grp_degree == 2 and r.word_degree == 3 for r in nodes)
    assert rows(reshape.pivot_vector(near, ["u", "v"])) == [("a", .5, 0.0), ("b", 0.0, .4), ("c", .2, 0.0)]


def test_pivot_without_null_rows_and_columns(spark):
    long = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "x", None), ("b", "y", None), ("c", "x", None), ("c", "z", 3.0), ("c", None, None)],
                                 "g string, t string, v double")
    wide = reshape.pivot_known(long, ["g"], "t", "v")
    assert wide.columns == ["g", "x", "z"]
    assert sorted(map(tuple, wide.collect())) == [("a", 1.0, None), ("c", None, 3.0)]
    assert reshape.pivot_known(long.where("v IS NULL"), ["g"], "t", "v").count() == 0


def _fold(frame, batch):
    parts = [frame.iloc[i:i + batch] for i in range(0, len(frame), batch)]
    out = pd.concat(list(pairs._fold(iter(parts))))
    return out.groupby(["grp", "a", "b"])["s"].sum()


def test_fold_is_exact_for_any_batches_and_chunks(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(g, d, t, float(rng.integers(1, 5))) for g in "ab" for d in range(30)
            for t in sorted(rng.choice(40, 6, replace=False))]
    frame = pd.DataFrame(rows, columns=["grp", "doc", "t", "x"])
    want = {}
    for (g, _), part in frame.groupby(["grp", "doc"]):
        for (_, p), (_, q) in itertools.product(part.iterrows(), part.iterrows()):
            if p.t <= q.t:
                want[g, p.t, q.t] = want.get((g, p.t, q.t), 0) + p.x * q.x
    for chunk, batch in ((2048, 1000), (4, 7), (3, 11)):
        monkeypatch.setattr(pairs, "CHUNK_DOCS", chunk)
        got = _fold(frame, batch)
        assert got.to_dict() == want


def test_cell_sums_match_the_fold_for_any_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(g, f"{g}{d}", int(t) << 40, float(rng.integers(1, 5))) for g in "ab" for d in range(20)
            for t in rng.choice(30, 5, replace=False)]
    table = spark.createDataFrame(rows, "grp string, doc_id string, term_id long, x double")
    want = {}
    for g, d in {(r[0], r[1]) for r in rows}:
        own = sorted((r[2], r[3]) for r in rows if r[1] == d)
        for (s, x), (t, y) in itertools.combinations(own, 2):
            want[g, s, t] = want.get((g, s, t), 0) + x * y
    assert {(r.grp, r.a, r.b): r.s for r in pairs.cell_sums(table, "x").collect()} == want


def test_pairs_are_shuffled_once_after_they_are_formed(spark):
    _, rows, _, vocab = _corpus(spark)
    cosine = distance.term_cosine(rows.withColumnRenamed("w", "tf"), vocab, 5)
    plan = cosine._jdf.queryExecution().optimizedPlan().toString()
    formed = plan.index("Generate explode(slice")
    assert plan[:formed].count("Aggregate [grp") == 1 and "Join" not in plan[plan.index("Aggregate [grp"):formed]


def test_cells_come_as_one_row_from_the_task_of_their_range(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(g, d, int(t), float(rng.integers(1, 5))) for g in ("a", "b", None) for d in range(40) for t in rng.choice(30, rng.integers(1, 12), replace=False)]
    rows += [("a", None, 3, 1.0), ("a", None, 29, 2.0), ("b", 500, 28, 1.0), ("b", 500, 29, 3.0), ("b", 501, 7, 1.0)]
    table = spark.createDataFrame(rows, "grp string, doc_id long, term_id long, x double")
    want = {}
    for g, d in {r[:2] for r in rows if r[0]}:
        for (s, x), (t, y) in itertools.combinations(sorted(r[2:] for r in rows if r[:2] == (g, d)), 2):
            want[g, s, t] = want.get((g, s, t), 0) + x * y
    monkeypatch.setattr(pairs, "CELLS", 30 * 7)
    monkeypatch.setattr(pairs, "CHUNK_PAIRS", 5)
    for most, split in ((1 << 27, False), (100, True)):
        monkeypatch.setattr(pairs, "PAIRS_PER_RANGE", most)
        assert {(r.grp, r.a, r.b): r.s for r in pairs.cell_sums(table, "x", n_terms=30).collect()} == want
        with monkeypatch.context() as patch:
            patch.setattr(pairs, "_total", lambda cells: cells)
            assert (pairs.cell_sums(table, "x", n_terms=30).count() > len(want)) == split
    assert pairs.cell_sums(table.where("doc_id > 500"), "x", n_terms=30).count() == 0
