import math

import numpy as np
import pytest

from textpulse.operators import terms, vocab, weights

DOCS = [  # doc_id, grp, text
    (1, "a", "apple pear apple"), (2, "a", "apple plum"), (3, "a", "fig fig fig"),
    (4, "b", "apple pear"), (5, "b", "pear plum"), (6, "b", ""),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, grp string, text string")


@pytest.fixture
def tf(docs):
    return terms.term_counts(terms.tokenize(docs))


def test_stats_and_per_group(tf, rows):
    stats = vocab.group_term_stats(tf)
    assert ("a", "apple", 2, 3) in rows(stats) and ("a", "fig", 1, 3) in rows(stats)
    assert rows(vocab.vocab_per_group(stats, 2)) == [("a", "apple", 2), ("b", "pear", 2)]


def test_shared(tf, rows):
    per_group = vocab.vocab_per_group(vocab.group_term_stats(tf), 1)
    assert rows(vocab.vocab_shared(per_group, 2)) == [("apple", 2), ("pear", 2), ("plum", 2)]


def test_common_needs_every_group(tf, docs, rows):
    stats = vocab.group_term_stats(tf)
    assert rows(vocab.vocab_common(stats, docs, 1, 0.5)) == [("plum", 2, 2)]
    assert rows(vocab.vocab_common(stats, docs, 2, 0.3)) == []


def test_pruned_limits_cap_and_ties(tf, docs, rows):
    stats, n = vocab.group_term_stats(tf), vocab.corpus_size(docs)
    assert rows(vocab.vocab_pruned(stats, n, 2, 0.5, 10)) == [("apple", 3, 4), ("pear", 3, 3), ("plum", 2, 2)]
    assert rows(vocab.vocab_pruned(stats, n, 1, 1.0, 2)) == [("apple", 3, 4), ("fig", 1, 3)]
    assert rows(vocab.vocab_pruned(stats, n, 0.4, 1.0, None)) == [("apple", 3, 4), ("pear", 3, 3)]
    assert rows(vocab.vocab_pruned(stats, n, 1, 1.0, None, group_min_df=1, min_groups=2)) == [
        ("apple", 3, 4), ("pear", 3, 3), ("plum", 2, 2)]


def test_tfidf_by_hand(tf, docs, rows):
    stats, n = vocab.group_term_stats(tf), vocab.corpus_size(docs)
    kept = vocab.vocab_pruned(stats, n, 2, 0.5, 10)
    got = {(d, t): w for d, t, w in rows(weights.tfidf(tf, kept, n, vocab_rows=10).select("doc_id", "term", "w"))}
    idf = {t: math.log(7 / (1 + df)) + 1 for t, df in (("apple", 3), ("pear", 3), ("plum", 2))}
    first = np.array([2 * idf["apple"], idf["pear"]])
    first /= np.linalg.norm(first)
    assert got[1, "apple"] == pytest.approx(first[0], abs=1e-6) and got[1, "pear"] == pytest.approx(first[1], abs=1e-6)
    assert {d for d, _ in got} == {1, 2, 4, 5}  # all tokens of 3 and 6 are gone
    for d in (1, 2, 4, 5):
        assert sum(w * w for (k, _), w in got.items() if k == d) == pytest.approx(1, abs=1e-5)
