"""A corpus that changes by batches equals one built from what is left."""

import datetime as dt
import random

import pytest

from textpulse.operators import deltas, terms, trends, vocab, weights

SCHEMA = "doc_id long, grp string, day date, text string"


def texts(n=40, seed=3):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(15)]
    return [(i, "ab"[i % 2], dt.date(2024, 1, 1 + i % 4), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(n)]


def counted(docs):
    return terms.term_counts(terms.tokenize(docs))


def same_as_rebuilt(spark, rows, corpus, live):
    docs = spark.createDataFrame(live, SCHEMA)
    n, counts = vocab.corpus_size(docs), counted(docs)
    limits = {"min_df": 2, "max_df": 1.0, "cap": 10}
    kept = vocab.vocab_pruned(vocab.group_term_stats(counts), n, **limits)
    assert rows(corpus.vocabulary(**limits)) == rows(kept)
    whole = weights.tfidf(counts, kept, n)
    assert rows(corpus.weights(kept).select("doc_id", "term", "w")) == rows(whole.select("doc_id", "term", "w"))
    means = trends.term_day_mean(whole, docs.select("doc_id", "grp", "day"), kept)
    assert rows(corpus.daily_means(kept)) == rows(means)


@pytest.fixture
def corpus(spark, tmp_path):
    return deltas.ChangingCorpus(spark, str(tmp_path / "corpus"), counted)


def test_batches_equal_a_rebuild(spark, rows, corpus):
    docs = texts()
    table = lambda some: spark.createDataFrame(some, SCHEMA)
    ids = lambda some: spark.createDataFrame([(i,) for i in some], "doc_id long")
    assert corpus.commit("one", table(docs[:25] + docs[:3]))  # repeated rows count once
    same_as_rebuilt(spark, rows, corpus, docs[:25])
    assert corpus.commit("two", table(docs[25:] + docs[20:25]), ids([1, 2, 3, 3, 30, 999]))  # 30 was not there before, 20 to 24 were
    live = [d for d in docs if d[0] not in (1, 2, 3)]
    same_as_rebuilt(spark, rows, corpus, live)
    assert not corpus.commit("two", None, ids([5]))  # delivered before
    assert corpus.commit("three", table(docs[1:3]), ids([1, 7, 8]))  # 1 comes back; what leaves was there before
    live = [d for d in docs if d[0] not in (3, 7, 8)]
    same_as_rebuilt(spark, rows, corpus, live)
    assert {r.doc_id for r in corpus.keys().collect()} == {d[0] for d in live}


def test_only_what_a_batch_touches_is_written(spark, corpus, tmp_path):
    docs = texts()
    corpus.commit("one", spark.createDataFrame(docs, SCHEMA))
    corpus.commit("two", spark.createDataFrame([(100, "a", dt.date(2024, 1, 1), "word1 word1 fresh")], SCHEMA))
    assert {r.term: (r.df, r.cf) for r in spark.read.parquet(f"{corpus.path}/batches/two/stats").collect()} == {"word1": (1, 2), "fresh": (1, 1)}


def test_a_batch_that_did_not_end_leaves_nothing(spark, rows, corpus):
    docs = texts(10)
    broken = deltas.ChangingCorpus(spark, corpus.path, lambda d: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.commit("one", spark.createDataFrame(docs, SCHEMA))
    assert corpus.keys() is None
    assert not corpus.commit("none", None, spark.createDataFrame([(1,)], "doc_id long"))
    assert corpus.commit("one", spark.createDataFrame(docs, SCHEMA))
    same_as_rebuilt(spark, rows, corpus, docs)


def test_everything_leaves(spark, rows, corpus):
    docs = texts(6)
    corpus.commit("one", spark.createDataFrame(docs, SCHEMA))
    corpus.commit("two", None, spark.createDataFrame([(i,) for i in range(6)], "doc_id long"))
    assert corpus.statistics().count() == corpus.keys().count() == 0


def test_only_kept_terms_are_shuffled_to_sum_their_signs(spark, corpus):
    corpus.commit("one", spark.createDataFrame(texts(), SCHEMA))
    kept = spark.createDataFrame([("word1", 5)], "term string, df long")
    plan = corpus.weights(kept)._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Aggregate [doc_id") < plan.index("LeftSemi")  # the choice is made below the sums
