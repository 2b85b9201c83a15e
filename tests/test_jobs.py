import datetime as dt

import numpy as np
import pytest

from textpulse.plans import jobs
from textpulse.plans.views import Dashboards

WORDS = ["budget", "cricket", "delhi", "election", "farmer", "metro", "monsoon", "onion"]


@pytest.fixture(scope="module")
def boards(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    items = [(f"v{i}", ["north", "south", "east"][i % 3], dt.datetime(2020, 1, 1 + i % 9), " ".join(rng.choice(WORDS, 3)).title(),
              " ".join(rng.choice(WORDS, 4)), f"u{i}") for i in range(90)]
    items += items[:5] + [("v99", None, dt.datetime(2020, 1, 1), "Lost", "group", "u99")]
    flat = spark.createDataFrame(items, "item_id string, grp string, published_at timestamp, title string, description string, url string")
    docs = jobs.corpus(flat).persist()
    assert docs.count() == 90
    out = str(tmp_path_factory.mktemp("tables"))
    jobs.prepare(docs, out, group_min_df=2, min_df=3, max_df=0.9)
    jobs.rank_terms(out, spark.read.parquet(f"{out}/term_day"))
    jobs.term_distances(docs, out)
    jobs.find_topics(docs, out, k=4, group_max_df=0.95)
    return Dashboards(spark, out)


def test_trend_and_proportion(boards):
    trend = boards.word_trend(["north"], "Delhi").toPandas()
    assert len(trend) == 9 and set(trend.grp) == {"north"} and trend.day.is_monotonic_increasing
    share = boards.word_proportion("All".split(), ["delhi", "onion"]).toPandas()
    assert len(share) == 6 and np.allclose(share.groupby("word")["share"].sum(), 1)
    assert boards.word_trend(None, "unknown").count() == 0 and boards.term_options("delhi").count() == 3


def test_correlations_and_ranks(boards):
    corr = boards.word_correlations(None, "delhi").toPandas()
    assert "delhi" not in set(corr.other) and corr["corr"].abs().max() <= 1 and len(corr) == 3 * 7
    top = boards.top_terms(None, ["delhi", "onion"]).toPandas()
    assert len(top) == 27 and set(top.term.dropna()) <= {"delhi", "onion"}
    assert boards.aligned_ranks(["delhi", "onion"]).columns == ["day", "grp", "delhi", "onion"]


def test_distances(boards):
    edges, pairs = boards.term_distances(["north"], "delhi")
    edges, pairs = edges.toPandas(), pairs.toPandas()
    assert set(edges.grp) == {"north"} and "delhi" not in set(edges.word)
    assert len(pairs) == 5 and (pairs[pairs.g1 == pairs.g2].dist == 0).all()
    assert boards.term_vector("delhi", ["delhi", "onion"]).count() == 3


def test_topics(boards):
    options = boards.topic_options("delhi").toPandas()
    assert len(options) and all("delhi" in label.split("-") for label in options.label)
    composition, scores, gaps = boards.topic(["north"], int(options.topic_id[0]))
    assert composition.count() == 5 and set(scores.toPandas().grp) == {"north"} and gaps.count() == 2
    documents = boards.topic_documents(int(options.topic_id[0]), 3).toPandas()
    assert len(documents) == 3 and documents.url.notna().all()
