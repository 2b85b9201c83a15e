"""The batch jobs: clean items in, derived tables out.

Each job writes parquet under ``out`` and later steps read what earlier ones wrote, so a lost executor costs at most
one step. Tables that are looked up by term are laid out for it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.functions import text
from textpulse.functions.stopwords import ENGLISH, WITH_EXTRA
from textpulse.operators import assoc, clean, distance, ranks, terms, topics, trends, vocab, weights
from textpulse.session import spread
from textpulse.sources import items, store


def flatten(raw: DataFrame, out: str, key: str = "doc_id", column: str = "json") -> DataFrame:
    """Flat items of raw documents; those that cannot be placed are kept, with key and text, in ``out/quarantine``."""
    parsed = items.parse_items(raw, column, keep=(key, column))
    _save(items.malformed_items(parsed).select(key, F.col(column).alias("raw")), f"{out}/quarantine")
    return items.flatten_items(parsed)


def corpus(items: DataFrame, sep: str = "\n") -> DataFrame:
    """Flat items with a group name -> ``doc_id, grp, day, text, title, url``: no duplicates, no nulls."""
    rows = clean.drop_nulls(clean.dedupe(items))
    return rows.select(F.col("item_id").alias("doc_id"), "grp", F.to_date("published_at").alias("day"),
                       text.assemble(F.col("title"), F.col("description"), sep=sep).alias("text"), "title", "url")


def _save(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def prepare(docs: DataFrame, out: str, boilerplate: DataFrame | None = None, stop_words: Iterable[str] = WITH_EXTRA,
            group_min_df: int = 5, min_groups: int = 2, min_df: int | float = 10, max_df: int | float = 0.5,
            cap: int = vocab.MAX_TERMS) -> None:
    """Vocabulary, weights, daily means and correlations of ``docs(doc_id, grp, day, text)``."""
    docs = docs.select("doc_id", "grp", "day", "text")
    keys, n = docs.drop("text"), vocab.corpus_size(docs)
    tf = terms.term_counts(terms.tokenize(spread(docs, "doc_id"), stop_words=stop_words))
    if boilerplate is not None:
        tf = terms.without_terms(tf, terms.boilerplate_terms(boilerplate))
    kept = _save(vocab.vocab_pruned(vocab.group_term_stats(tf), n, min_df, max_df, cap, group_min_df, min_groups),
                 f"{out}/vocab")
    weighted = _save(weights.tfidf(tf, kept, n, vocab_rows=cap), f"{out}/weights")
    store.write_by_term(trends.term_day_mean(weighted, keys, kept), f"{out}/term_day")
    moments = _save(assoc.term_moments(weighted, keys, kept, cap), f"{out}/term_moments")
    store.write_by_term(assoc.term_corr(weighted, keys, kept, vocab_rows=cap, moments=moments), f"{out}/term_corr")


def rank_terms(out: str, series: DataFrame, window: int = trends.WINDOW) -> None:
    """Ranks of all terms per day and group, from the stored daily means."""
    store.write_by_term(ranks.term_rank(series, window), f"{out}/term_rank")


def term_distances(docs: DataFrame, out: str, stop_words: Iterable[str] = ENGLISH, min_df: int | float = 0.001,
                   nearest: int = distance.NEAREST) -> None:
    """Nearest words per term and group, and group distances per term, over one- and two-word terms."""
    docs = clean.drop_nulls(docs.select("doc_id", "grp", "text"), ["text"])
    tokenized = terms.tokenize(spread(docs, "doc_id"), text.ascii_tokens, stop_words, bigrams=True)
    counts = terms.term_counts(tokenized)
    stats = vocab.group_term_stats(counts)
    words = _save(vocab.vocab_pruned(stats, vocab.corpus_size(docs), min_df, 1.0, cap=None), f"{out}/ngrams")
    size = words.count()
    kept = _save(terms.only_terms(counts, words, size), f"{out}/ngram_counts")
    near = distance.term_nearest(distance.term_cosine(kept, words, size), words, docs, nearest)
    store.write_by_term(near, f"{out}/term_near")
    stored = docs.sparkSession.read.parquet(f"{out}/term_near")
    store.write_by_term(distance.group_distance(stored), f"{out}/group_dist")


def find_topics(docs: DataFrame, out: str, stop_words: Iterable[str] = ENGLISH, k: int = topics.MAX_TOPICS,
                group_min_df: int | float = 2, group_max_df: int | float = 0.3, min_df: int | float = 0.005) -> None:
    """Topics, their terms, document scores and each document's top topics, with title and url where ``docs`` has them."""
    docs = clean.drop_nulls(docs, ["text"])
    tokenized = terms.tokenize(spread(docs.select("doc_id", "grp", "text"), "doc_id"), text.ascii_tokens, stop_words)
    n = vocab.corpus_size(docs)
    common = vocab.vocab_common(vocab.group_term_stats(terms.term_counts(tokenized)), docs, group_min_df, group_max_df)
    kept = _save(vocab.prune(common, n, min_df, 1.0, cap=None), f"{out}/topic_vocab")
    vectors, words = topics.tfidf_vectors(tokenized, kept, n)
    model = topics.svd_topics(_save(vectors, f"{out}/topic_vectors"), words, k)
    found = _save(model.topics, f"{out}/topics")
    components = _save(model.components, f"{out}/topic_components")
    _save(topics.topic_terms(components), f"{out}/topic_terms")
    scores = _save(model.scores, f"{out}/doc_topics")
    best = topics.doc_top_topics(topics.sigma_weighted(scores, found))
    extra = [c for c in ("title", "url") if c in docs.columns]
    _save(best.join(docs.select("doc_id", *extra), "doc_id") if extra else best, f"{out}/doc_top_topics")
