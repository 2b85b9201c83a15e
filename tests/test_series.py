import datetime as dt

import numpy as np
import pandas as pd
import pytest

from textpulse.operators import ranks, reshape, trends

D = [dt.date(2024, 1, i) for i in range(1, 6)]


def test_mean_has_three_states(spark, rows):
    docs = spark.createDataFrame([(1, "a", D[0]), (2, "a", D[0]), (3, "b", D[1])], "doc_id long, grp string, day date")
    weights = spark.createDataFrame([(1, "a", D[0], "x", 0.5)], "doc_id long, grp string, day date, term string, w double")
    terms = spark.createDataFrame([("x",), ("y",)], "term string")
    got = {r[:3]: r[3] for r in rows(trends.term_day_mean(weights, docs, terms))}
    assert len(got) == 2 * 2 * 2
    assert got[D[0], "a", "x"] == 0.25  # over both documents of the cell
    assert got[D[1], "b", "x"] == 0.0 and got[D[1], "a", "x"] is None and got[D[0], "b", "y"] is None


def _series(spark, values):
    return spark.createDataFrame([(d, g, t, v) for (g, t), vs in values.items() for d, v in zip(D, vs)],
                                 "day date, grp string, term string, mean_prop double")


def test_trend_counts_null_as_zero(spark, rows):
    got = rows(trends.word_trend(_series(spark, {("a", "x"): [1.0, None, 2.0]}), window=2))
    assert [r[4] for r in got] == [1.0, 0.5, 1.0]


def test_trend_default_window_is_fourteen_rows(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=3 * i) for i in range(20)]
    values = np.random.default_rng(1).random(20)
    series = spark.createDataFrame([(d, "a", "x", float(v)) for d, v in zip(days, values)],
                                   "day date, grp string, term string, mean_prop double")
    got = [r.rolling for r in trends.word_trend(series).orderBy("day").collect()]
    assert np.allclose(got, pd.Series(values).rolling(14, 1).mean())


def test_rank_matches_pandas(spark):
    rng = np.random.default_rng(7)
    table = {(g, t): [float(v) if rng.random() > 0.3 else 0.0 for v in rng.integers(0, 4, 5) / 4]
             for g in "ab" for t in "uvwxy"}
    got = ranks.term_rank(_series(spark, table), window=3).toPandas().set_index(["grp", "day", "term"])["rank"]
    for g in "ab":
        wide = pd.DataFrame({t: table[g, t] for t in "uvwxy"}, index=D).replace(0, np.nan)
        want = wide.rolling(3, 1).mean().round(9).rank(axis=1, ascending=False)
        for d in D:
            for t in "uvwxy":
                assert got[g, d, t] == want.loc[d, t] or (np.isnan(got[g, d, t]) and np.isnan(want.loc[d, t]))


def test_mean_rank_of_a_full_cell(spark):
    series = _series(spark, {("a", t): [v] * 5 for t, v in zip("uvwx", (.1, .2, .2, .4))})
    got = ranks.term_rank(series).where("day = '2024-01-03'").toPandas()
    assert got["rank"].mean() == 2.5 and sorted(got["rank"]) == [1, 2.5, 2.5, 4]


def test_ordinal_rank(spark, rows):
    got = rows(ranks.term_rank_ordinal(_series(spark, {("a", "u"): [.3], ("a", "v"): [None], ("a", "w"): [.3], ("a", "x"): [.1]})))
    assert {r[2]: r[3] for r in got} == {"u": 1, "v": -1, "w": 2, "x": 0}


def test_top_term_uses_ranks_of_all_terms_and_keeps_empty_cells(spark, rows):
    table = {("a", "u"): [.5, 0.0], ("a", "v"): [.9, 0.0], ("a", "w"): [.5, .1]}
    ranked = ranks.term_rank(_series(spark, table), window=1)
    assert rows(ranks.top_term(ranked, ["u", "w"])) == [(D[0], "a", "u"), (D[1], "a", "w")]
    assert rows(ranks.top_term(ranked, ["u"])) == [(D[0], "a", "u"), (D[1], "a", None)]
    assert rows(ranks.top_term(ranked, ["unknown"])) == []


def test_align_and_melt(spark, rows):
    wide = ranks.align_series(_series(spark, {("a", "u"): [.1, .2], ("a", "v"): [.3]}), ["u", "v"])
    assert rows(wide, ordered=True) == [(D[0], "a", .1, .3), (D[1], "a", .2, None)]
    assert len(rows(reshape.melt(wide, ["day", "grp"], ["u", "v"]))) == 4


def test_map_round_trip_keeps_nulls(spark, rows):
    series = _series(spark, {("a", "u"): [.1, None], ("b", "u"): [.3, .4], ("a", "v"): [0.0]})
    assert rows(reshape.decode_series(reshape.encode_series(series))) == rows(series)


def test_shares(spark, rows):
    series = _series(spark, {("a", "u"): [.1, None], ("b", "u"): [.3, .0], ("a", "v"): [0.0, 0.0], ("b", "v"): [0.0, 0.0]})
    total = trends.word_proportion(trends.words_union(series, ["u", "v", "unknown"]))
    assert ("a", "u", 0.05) in rows(total)
    assert ("a", "u", 0.25) in rows(trends.group_share(total)) and ("a", "v", None) in rows(trends.group_share(total))
    assert rows(trends.group_share(total.where("grp = 'a' AND word = 'u'"))) == [("a", "u", 0.05)]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_ranks_do_not_depend_on_partitioning(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rows(ranks.term_rank(_series(spark, {("a", t): [.2, .1, .2] for t in "uvw"})))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r[3] for r in got] == [2.0] * 9
