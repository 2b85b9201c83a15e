"""What the dashboards ask of the derived tables, up to the rows handed to a chart.

``groups`` is the checklist: names, or "All" (or None) for no restriction. Terms are looked up in lower case. An
unknown term gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.operators import assoc, clean, compare, distance, ranks, reshape, topics, trends
from textpulse.sources import store

Groups = Iterable[str] | None


class Dashboards:
    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out

    def _terms(self, table: str, words: Iterable[str]) -> DataFrame:
        return store.read_terms(self.spark, f"{self.out}/{table}", [w.lower() for w in words])

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{name}")

    def term_options(self, word: str) -> DataFrame:
        """The groups to choose from for a term."""
        return clean.distinct_groups(self._terms("term_day", [word]))

    def word_trend(self, groups: Groups, word: str) -> DataFrame:
        return trends.word_trend(clean.in_groups(self._terms("term_day", [word]), groups)).orderBy("day", "grp")

    def word_proportion(self, groups: Groups, words: list[str]) -> DataFrame:
        series = trends.words_union(self._terms("term_day", words), [w.lower() for w in words])
        total = trends.word_proportion(clean.in_groups(series, groups))
        return total.join(trends.group_share(total), ["grp", "word"])

    def word_correlations(self, groups: Groups, word: str) -> DataFrame:
        return assoc.word_correlations(clean.in_groups(self._terms("term_corr", [word]), groups))

    def term_distances(self, groups: Groups, word: str) -> tuple[DataFrame, DataFrame]:
        """The term's graph (edges with node attributes) and its group distances."""
        edges = distance.node_join(distance.term_edges(self._terms("term_near", [word])))
        pairs = self._terms("group_dist", [word])
        return clean.in_groups(edges, groups), clean.pairs_touching(pairs, groups)

    def top_terms(self, groups: Groups, words: list[str]) -> DataFrame:
        ranked = clean.in_groups(self._terms("term_rank", words), groups)
        return ranks.top_term(ranked, [w.lower() for w in words]).orderBy("day", "grp")

    def aligned_ranks(self, words: list[str]) -> DataFrame:
        words = [w.lower() for w in words]
        return ranks.align_series(self._terms("term_rank", words), words, "rank")

    def term_vector(self, word: str, columns: list[str], fill: float = 0.0) -> DataFrame:
        return reshape.pivot_vector(self._terms("term_near", [word]), columns, fill)

    def topic_options(self, word: str) -> DataFrame:
        """Topics that list the term, strongest first, with their labels."""
        listed = self._table("topic_terms")
        held = topics.topics_with_term(listed, word.lower())
        return held.join(topics.topic_labels(listed), "topic_id").orderBy(F.desc("weight"), "topic_id")

    def topic(self, groups: Groups, topic_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Composition, scores (with sigma) of the chosen groups, and significance-gated group distances."""
        found = self._table("topics")
        listed = topics.topic_by_id(self._table("topic_terms"), topic_id)
        composition = topics.topic_composition(topics.topic_rows(topics.encode_topics(listed, found)))
        scores = topics.scores_of_topic(self._table("doc_topics"), found, topic_id)
        gaps = compare.topic_group_distance(compare.topic_group_diff(scores), found)
        return composition, clean.in_groups(scores, groups), clean.pairs_touching(gaps, groups)

    def topic_documents(self, topic_id: int, n: int = 10) -> DataFrame:
        best = self._table("doc_top_topics")
        top = topics.topic_top_docs(best, topic_id, n)
        extra = [c for c in ("title", "url") if c in best.columns]
        return top.join(best.select("doc_id", "topic_id", *extra), ["doc_id", "topic_id"]) if extra else top
