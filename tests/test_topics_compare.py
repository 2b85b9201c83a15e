import numpy as np
import pytest

from textpulse.functions.numeric import studentized_range_critical, studentized_range_sf
from textpulse.operators import compare, terms, topics, vocab
from textpulse.session import stored

TEXTS = ["red apple pie", "green apple tart", "red wine glass", "green wine bottle", "apple wine", "pie tart",
         "glass bottle red", "green red", "apple pie tart glass", "wine bottle apple", "zzz"]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(f"v{i}", "ab"[i % 2], t) for i, t in enumerate(TEXTS)], "doc_id string, grp string, text string")
    tokenized = terms.tokenize(docs)
    n = vocab.corpus_size(docs)
    kept = vocab.vocab_pruned(vocab.group_term_stats(terms.term_counts(tokenized)), n, 2, 1.0, None)
    vectors, words = topics.tfidf_vectors(tokenized, kept, n)
    vectors = vectors.persist()
    dense = np.array([r.features.toArray() for r in vectors.orderBy("doc_id").collect()])
    return topics.svd_topics(vectors, words, 4), words, dense, sorted(f"v{i}" for i in range(len(TEXTS)))


def test_singular_values_and_reconstruction(model):
    found, words, dense, ids = model
    sigma = [r.sigma for r in found.topics.orderBy("topic_id").collect()]
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(sigma, s[:4])
    v = np.zeros((4, len(words)))
    for r in found.components.collect():
        v[r.topic_id, words.index(r.term)] = r.weight
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-8)
    assert all(row[np.abs(row).argmax()] > 0 for row in v)
    scores = np.zeros((len(ids), 4))
    for r in found.scores.collect():
        scores[ids.index(r.doc_id), r.topic_id] = r.score
    assert np.allclose(scores @ v, (u[:, :4] * s[:4]) @ vt[:4], atol=1e-8)
    assert np.allclose(scores[ids.index("v10")], 0)  # no token kept


def test_fewer_topics_are_the_strongest(model, spark):
    found, words, dense, _ = model
    sigma = sorted((r.sigma for r in found.topics.collect()), reverse=True)
    assert np.allclose(sigma[:3], np.linalg.svd(dense)[1][:3])


def test_topic_lists(spark, rows):
    comps = spark.createDataFrame([(0, t, w) for t, w in zip("abcdefg", (.1, .6, -.9, .3, .3, .2, .05))],
                                  "topic_id int, term string, weight double")
    listed = topics.topic_terms(comps, 4)
    assert rows(listed.select("pos", "term", "weight")) == [(1, "f", .2), (2, "e", .3), (3, "d", .3), (4, "b", .6)]
    assert rows(topics.topic_labels(listed)) == [(0, "f-e-d-b")]
    found = spark.createDataFrame([(0, 2.0)], "topic_id int, sigma double")
    table = topics.topic_rows(topics.encode_topics(listed, found))
    assert (0, "b", .6, 2.0) in rows(table)
    assert sum(r.share for r in topics.topic_composition(table).collect()) == pytest.approx(1)
    assert rows(topics.topics_with_term(listed, "zz")) == []


def test_top_topics_use_signed_scores(spark, rows):
    scores = spark.createDataFrame([(d, "a", t, s) for d, row in ((1, (-9., 1., 2.)), (2, (3., -1., .5))) for t, s in enumerate(row)],
                                   "doc_id long, grp string, topic_id int, score double")
    found = spark.createDataFrame([(0, 1.0), (1, 4.0), (2, 1.0)], "topic_id int, sigma double")
    best = topics.doc_top_topics(topics.sigma_weighted(scores, found), 2)
    assert rows(best) == [(1, "a", 1, 4.0, 1), (1, "a", 2, 2.0, 2), (2, "a", 0, 3.0, 1), (2, "a", 2, .5, 2)]
    assert rows(topics.topic_top_docs(best, 2, 1)) == [(1, "a", 2, 2.0)]


@pytest.mark.parametrize("q, k, df, alpha", [  # published table of the studentised range
    (4.232, 5, 20, .05), (3.578, 3, 20, .05), (5.294, 5, 20, .01), (2.772, 2, 1e6, .05), (4.474, 10, 1e6, .05), (17.97, 2, 1, .05)])
def test_studentised_range_table(q, k, df, alpha):
    assert studentized_range_sf(q, k, df) == pytest.approx(alpha, abs=4e-4)
    assert studentized_range_critical(alpha, k, df) == pytest.approx(q, abs=2e-2)


def test_tukey_by_hand(spark):
    groups = {"a": [1., 2., 3.], "b": [1.5, 2.5, 3.5, 2.5], "c": [8., 9., 10.]}
    scores = spark.createDataFrame([(0, g, v) for g, vs in groups.items() for v in vs], "topic_id int, grp string, score double")
    got = {(r.g1, r.g2): r for r in compare.topic_group_diff(scores).collect()}
    assert len(got) == 3
    mse = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values()) / 7
    r = got["a", "b"]
    assert r.meandiff == pytest.approx(0.5) and r.se == pytest.approx(np.sqrt(mse / 2 * (1 / 3 + 1 / 4)))
    assert not r.reject and got["a", "c"].reject and got["a", "c"].p_adj < .01 < r.p_adj
    assert r.lower < r.meandiff < r.upper and r.lower < 0 < r.upper
    gated = compare.topic_group_distance(compare.topic_group_diff(scores), spark.createDataFrame([(0, 2.0)], "topic_id int, sigma double"))
    assert {(x.g1, x.g2): round(x.dist, 6) for x in gated.collect()} == {("a", "b"): 0.0, ("a", "c"): 14.0, ("b", "c"): 13.0}


def test_densities_integrate_to_one(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(0, 1, 200), "b": rng.normal(3, 1, 100)}
    scores = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "grp string, score double")
    both = np.concatenate(list(values.values()))
    step = (both.max() - both.min()) / 20
    hist = compare.score_density(scores, 20).toPandas()
    assert np.allclose(hist.groupby("grp")["density"].sum() * step, 1)
    kernel = compare.kernel_density(scores, 30).toPandas().sort_values(["grp", "point"])
    for g, vs in values.items():
        part = kernel[kernel.grp == g]
        h = .9 * vs.std(ddof=1) * len(vs) ** -.2
        want = np.exp(-((part.x.to_numpy()[:, None] - vs) / h) ** 2 / 2).sum(axis=1) / (len(vs) * h * np.sqrt(2 * np.pi))
        assert np.allclose(part.density, want)


def test_empty_vocabulary_gives_no_topics(spark):
    tokenized = terms.tokenize(spark.createDataFrame([(1, "a", "one")], "doc_id long, grp string, text string"))
    none = spark.createDataFrame([], "term string, df long")
    vectors, words = topics.tfidf_vectors(tokenized, none, vocab.corpus_size(tokenized))
    found = topics.svd_topics(vectors, words)
    assert words == [] and found.topics.count() == found.components.count() == found.scores.count() == 0


def test_term_products_are_made_by_blocks_of_matrices(spark, monkeypatch):
    monkeypatch.setattr(topics, "PRODUCT_TERMS", 4)
    x = np.random.default_rng(3).normal(size=(11, 5))
    rows = spark.createDataFrame([(k, f"t{i}", float(x[i, k])) for i in range(11) for k in range(5)], "topic_id int, term string, x double")
    parts = stored(rows, "parts")
    found = topics.term_products(parts, 11)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no row for a pair of terms and a topic
    got = {(r.term, r.other): r.s for r in found.collect()}
    want = x @ x.T
    assert len(got) == 121 and all(abs(got[f"t{i}", f"t{j}"] - want[i, j]) < 1e-12 for i in range(11) for j in range(11))
    assert topics.term_products(parts.limit(0), 0).collect() == []
