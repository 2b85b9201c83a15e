"""Topics by blocks of directions: values, spaces, updates, and the highest scores without the table of all scores."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors

from textpulse.operators import svd, topics

DOCS, TERMS = 400, 120


def matrix(seed=1, decay=0.93):
    """Sparse rows around a few directions, with empty, repeated and dense ones; every row has the length 1."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, TERMS)) * (rng.random((40, TERMS)) < 0.3)
    x = (rng.normal(size=(DOCS, 40)) * decay ** np.arange(40)) @ base
    x *= rng.random(x.shape) < 0.4
    x[::50] = 0
    x[3::40] = x[3]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def table(spark, x, partitions=11):
    rows = [(i, "ab"[i % 2], Vectors.dense(r) if i % 70 == 1 else Vectors.sparse(TERMS, {int(j): float(r[j]) for j in np.flatnonzero(r)}))
            for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["doc_id", "grp", "features"]).repartition(partitions).persist()


@pytest.fixture(scope="module")
def known(spark):
    x = matrix()
    return table(spark, x), x


WORDS = [f"t{i:03d}" for i in range(TERMS)]


@pytest.mark.parametrize("k, oversample, passes, wide", [(10, 6, 8, 4096), (10, 8, 8, 0), (5, 6, 8, 0), (TERMS, 56, 8, 0), (30, 56, 8, 0)])
def test_values_and_space(known, monkeypatch, k, oversample, passes, wide):
    vectors, x = known
    monkeypatch.setattr(svd, "OVERSAMPLE", oversample)
    monkeypatch.setattr(svd, "WIDE", wide)
    read = []
    through, triangle = svd.through, svd.triangle
    monkeypatch.setattr(svd, "through", lambda *a: read.append(1) or through(*a))
    monkeypatch.setattr(svd, "triangle", lambda *a: read.append(1) or triangle(*a))
    sigma, v = svd.truncated(vectors.select("features"), TERMS, k, passes)
    assert len(read) <= passes
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.abs(sigma - s[:k]).max() < 1e-6
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-9
    assert (v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] > 0).all()
    apart = s[:k - 1] - s[1:k] > 1e-2
    assert all(abs(abs(v[:, i] @ vt[i]) - 1) < 1e-4 for i in np.flatnonzero(apart[:3]))


def test_the_tree_of_triangles_is_the_triangle_of_all_rows(spark, known):
    vectors, x = known
    basis = np.linalg.qr(np.random.default_rng(2).normal(size=(TERMS, 7)))[0]
    r = svd.triangle(vectors.select("features"), basis)
    assert r.shape == (7, 7) and np.allclose(r.T @ r, basis.T @ x.T @ x @ basis, atol=1e-10)
    few = vectors.select("features").limit(3).repartition(20)
    assert len(svd.triangle(few, basis)) <= 3
    assert svd.triangle(vectors.select("features").limit(0), basis).shape == (0, 7)


def test_more_values_than_the_rows_have(spark):
    x = np.zeros((4, TERMS))
    x[0, 5] = x[1, 5] = x[2, 7] = 1
    sigma, v = svd.truncated(table(spark, x, 2).select("features"), TERMS, 10)
    assert np.allclose(sigma[:2], [2 ** .5, 1]) and np.allclose(sigma[2:], 0) and len(sigma) == 10
    assert np.allclose(v.T @ v, np.eye(10)) and v[5, 0] == pytest.approx(1) and v[7, 1] == pytest.approx(1)


def test_a_basis_has_a_bound(known, monkeypatch):
    monkeypatch.setattr(svd, "MOST_BYTES", 16 * TERMS * 16 * 3)
    monkeypatch.setattr(svd, "WIDE", 0)
    assert svd._affordable(TERMS, 16, 7) == 3
    with pytest.raises(ValueError):
        svd.truncated(known[0].select("features"), TERMS, 60)


def test_an_update_equals_the_whole_if_all_topics_were_kept(known):
    vectors, x = known
    first = topics.svd_topics(vectors.where("doc_id < 150"), WORDS)
    both = topics.update_topics(first, vectors.where("doc_id >= 150"))
    whole = topics.svd_topics(vectors, WORDS)
    gaps = topics.model_gaps(both, whole)
    assert gaps["sigma_gap"] < 1e-9 and gaps["angle"] < 1e-6
    assert {r.doc_id for r in both.scores.select("doc_id").distinct().collect()} == set(range(150, DOCS))


@pytest.mark.parametrize("wide", [0, 4096])
def test_updates_of_a_truncated_model_stay_near(known, monkeypatch, wide):
    monkeypatch.setattr(svd, "OVERSAMPLE", 10)
    monkeypatch.setattr(svd, "WIDE", wide)
    vectors, x = known
    k = 25
    model = topics.svd_topics(vectors.where("doc_id < 100"), WORDS, k)
    for lo in range(100, DOCS, 100):
        model = topics.update_topics(model, vectors.where(f"doc_id >= {lo} AND doc_id < {lo + 100}"), k)
    s = np.linalg.svd(x)[1]
    assert (model.sigma <= s[:k] + 1e-9).all() and np.abs(model.sigma[:8] / s[:8] - 1).max() < 0.02
    empty = topics.update_topics(model, vectors.limit(0), k)
    assert np.allclose(empty.sigma, model.sigma)


def test_top_topics_without_all_scores_are_those_of_the_full_table(known, rows):
    vectors, _ = known
    model = topics.svd_topics(vectors, WORDS, 60)
    full = topics.doc_top_topics(topics.sigma_weighted(model.scores, model.topics))
    fast = topics.top_topics(vectors, model)
    assert rows(fast) == rows(full) and fast.count() == 10 * DOCS
    report = topics.topic_report(fast, topics.topic_labels(topics.topic_terms(model.components)), model.topics, 3)
    for r in report.where("topic_id = 2").collect():
        one = topics.topic_top_docs(full, 2, 3).collect()[r.place - 1]
        assert (r.doc_id, round(r.score, 9)) == (one.doc_id, round(one.score, 9))


def test_a_document_stops_when_later_topics_cannot_reach_its_best(monkeypatch):
    rng = np.random.default_rng(3)
    v = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    sigma = 10.0 * 0.9 ** np.arange(200)
    x = np.concatenate([v[:, :5].T, v[:, 150:155].T])  # five documents of early topics, five of late ones
    read = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *b, **c: read.append(len(a)) or partition(a, *b, **c))
    topic, score = topics._threshold(x, sigma, v, 1)
    assert topic[:, 0].tolist() == [*range(5), *range(150, 155)] and np.allclose(score[:, 0], sigma[topic[:, 0]])
    assert read[0] == 10 and read[1] == 5


def test_dense_and_sparse_vectors_are_read_alike():
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    column = pa.array([{"type": 0, "size": 3, "indices": [2], "values": [5.0]}, {"type": 1, "size": None, "indices": None, "values": [1.0, 0.0, 2.0]}], kind)
    bounds, at, values = svd.sparse_rows(column)
    assert bounds.tolist() == [0, 1, 4] and at.tolist() == [2, 0, 1, 2] and values.tolist() == [5, 1, 0, 2]
    bounds, at, values = svd.sparse_rows(column.slice(0, 1))
    assert bounds.tolist() == [0, 1] and at.tolist() == [2] and values.tolist() == [5]


@pytest.mark.parametrize("blocks", [8, 2])
def test_values_and_vectors_are_exact_whatever_the_vocabulary_and_the_memory(spark, monkeypatch, blocks):
    """A slowly falling spectrum, of which eight passes see too little; terms 0 and 1 have equal columns."""
    monkeypatch.setattr(svd, "OVERSAMPLE", 6)
    monkeypatch.setattr(svd, "WIDE", 0)
    monkeypatch.setattr(svd, "MOST_BYTES", 16 * TERMS * 12 * blocks // (2 if blocks == 2 else 1))
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, TERMS)) * (rng.random((300, TERMS)) < 0.2)
    x[:, :6] *= 4 - 0.4 * np.arange(6)
    x[:, 1] = x[:, 0]
    sigma, v = svd.truncated(table(spark, x, 3).select("features"), TERMS, 6)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    vt *= np.where(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)] < 0, -1, 1)[:, None]
    assert np.abs(sigma - s[:6]).max() < 1e-10 and np.abs(v - vt[:6].T).max() < 1e-6
    assert np.abs(v[0] - v[1]).max() < 1e-12


def test_a_topic_report_does_not_depend_on_the_memory_of_the_solver(spark, monkeypatch, rows):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, TERMS)) * (rng.random((200, TERMS)) < 0.2)
    x[:, :5] *= 5 - 0.5 * np.arange(5)
    vectors, found = table(spark, x, 3), []
    monkeypatch.setattr(svd, "OVERSAMPLE", 10)
    for blocks in (12, 1):
        monkeypatch.setattr(svd, "MOST_BYTES", 16 * TERMS * 15 * blocks)
        monkeypatch.setattr(svd, "BLOCKS", blocks)
        monkeypatch.setattr(svd, "WIDE", 4096 if blocks > 1 else 0)
        model = topics.svd_topics(vectors, WORDS, 5)
        report = topics.topic_report(topics.top_topics(vectors, model), topics.topic_labels(topics.topic_terms(model.components)), model.topics)
        found.append(rows(report))
    assert found[0] == found[1] and len(found[0]) == 50
