"""The registered queries: one per operator, each over whole tables.

Parameters follow the defaults of the operators; where a default is meant for short texts (titles), the value used
here is named below.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.functions import dates, text
from textpulse.functions.stopwords import ENGLISH, WITH_EXTRA
from textpulse.operators import assoc, clean, compare, counts, deltas, distance, ordinals, ranks, reshape, terms, topics, trends, vocab, weights
from textpulse.plans import corpora
from textpulse.session import shared_dir, spread, stored
from textpulse.sources import articles, items, pages, store
from textpulse.streaming import refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NGRAM_MIN_DF = 0.001  # share of documents
GROUPS = ["src0", "src1", "src2"]
WORDS = ["anvil", "blue", "widget"]
AS_OF = dt.datetime(2024, 1, 31)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, folder)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def r6(x: str | Column, name: str | None = None) -> Column:
    """Six decimals, no negative zero: summation order differs between engines."""
    column = F.col(x) if isinstance(x, str) else x
    return (F.round(column, 6) + F.lit(0.0)).alias(name or x)


class Main:
    """The batch job's chain over C1: tokens -> counts -> vocabulary -> weights -> daily series."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def docs(self) -> DataFrame:
        return corpora.documents(self.spark, self.folder)

    @cached_property
    def keys(self) -> DataFrame:
        return corpora.document_keys(self.spark, self.folder)

    @cached_property
    def n(self) -> Column:
        return vocab.corpus_size(self.keys)

    @cached_property
    def boilerplate(self) -> DataFrame:
        return terms.boilerplate_terms(corpora.table(self.spark, self.folder, "benchmark").select("text"))

    @cached_property
    def tokenized(self) -> DataFrame:
        return terms.tokenize(self.docs, stop_words=WITH_EXTRA)

    @cached_property
    def tf(self) -> DataFrame:
        return terms.without_terms(terms.term_counts(self.tokenized), self.boilerplate)

    @cached_property
    def stats(self) -> DataFrame:
        return vocab.group_term_stats(terms.without_terms(counts.group_counts(self.tokenized), self.boilerplate))

    @cached_property
    def vocab(self) -> DataFrame:
        """At most 1000 rows; kept, because every later step reads it."""
        return vocab.vocab_pruned(self.stats, self.n, group_min_df=5, min_groups=2).persist()

    @cached_property
    def weights(self) -> DataFrame:
        return weights.tfidf(self.tf, self.vocab, self.n, vocab_rows=vocab.MAX_TERMS)

    def top(self, n: int) -> DataFrame:
        return vocab.most_frequent(self.vocab, n)

    def series(self, chosen: DataFrame | None = None) -> DataFrame:
        """Daily means of the whole vocabulary or of chosen terms of it. Norms always come from the whole one."""
        if chosen is None:
            return trends.term_day_mean(self.weights, self.keys, self.vocab)
        rows = self.weights.join(F.broadcast(chosen), "term", "left_semi")
        return trends.term_day_mean(rows, self.keys, chosen)


class Ngrams:
    """The distance job's chain: one- and two-word terms -> counts -> cosine -> nearest.

    Cosines of all terms with all others are formed of whole pages (C1) and of short texts (C3). What is made of the nearest words
    comes from all terms of short texts, and from one chosen term of pages, as a dashboard asks. The vocabulary rule is the same.
    """

    def __init__(self, spark: SparkSession, folder: str, short: bool = False):
        self.short = short
        self.docs = corpora.conversations(spark, folder) if short else corpora.documents(spark, folder).drop("day")
        self.keys = self.docs.select("doc_id", "grp")

    @cached_property
    def cells(self) -> DataFrame:
        """A row a document with all terms that can be frequent enough; the vocabulary is counted from them."""
        tokenized = terms.tokenize(self.docs, text.ascii_tokens, ENGLISH)
        return stored(counts.frequent_cells(tokenized, NGRAM_MIN_DF * self.keys.count(), bigrams=True), "ngram-cells")

    @cached_property
    def vocab(self) -> DataFrame:
        totals = vocab.term_totals(self.cells.select(F.inline("cells")))
        return stored(vocab.prune(totals, vocab.corpus_size(self.keys), NGRAM_MIN_DF, 1.0, cap=None), "ngrams")

    @cached_property
    def size(self) -> int:
        return self.vocab.count()

    @cached_property
    def counts(self) -> DataFrame:
        rows = self.cells.select("doc_id", "grp", F.inline("cells"))
        return terms.only_terms(rows, self.vocab, vocab_rows=self.size)

    @cached_property
    def chosen(self) -> DataFrame | None:
        """The most frequent term of whole pages; no choice among short texts."""
        return None if self.short else vocab.most_frequent(self.vocab, 1)

    @cached_property
    def all_cosine(self) -> DataFrame:
        """A row for each ordered pair of terms that share a document of a group."""
        return distance.term_cosine(self.counts, self.vocab, self.size, cells=self.cells)

    @cached_property
    def cosine(self) -> DataFrame:
        return distance.term_cosine(self.counts, self.vocab, self.size, self.chosen, self.cells)

    @cached_property
    def near(self) -> DataFrame:
        """At most 60 rows per term; stored, because group distances and edges read it several times."""
        return stored(distance.term_nearest(self.cosine, self.vocab, self.keys, chosen=self.chosen), "near")


def _items(spark, folder):
    return items.flatten_items(items.parse_items(corpora.item_documents(spark, folder)))


def _dictionary(spark, folder):
    """Group names for all sources but the last, which therefore stays unknown."""
    sources = corpora.table(spark, folder, "documents").select(F.col("source").alias("grp_id")).distinct()
    last = sources.agg(F.max("grp_id")).scalar()
    return sources.where(F.col("grp_id") < last).withColumn("grp", F.upper("grp_id"))


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query
def items_flatten(spark, folder):
    return _items(spark, folder)


@query
def malformed_items(spark, folder):
    """Some texts are cut off and some dates are no dates; key and raw text survive."""
    broken = F.when(F.col("doc_id") % 11 == 3, F.left("json", F.length("json") - 1)).when(
        F.col("doc_id") % 13 == 5, F.regexp_replace("json", '"publishedAt":"', '"publishedAt":"about ')).otherwise(F.col("json"))
    raw = corpora.item_documents(spark, folder).select("doc_id", broken.alias("json"))
    kept = items.malformed_items(items.parse_items(raw, keep=("doc_id", "json")))
    return kept.select("doc_id", F.contains("json", F.concat(F.lit('"id":"v'), F.col("doc_id").cast("string"), F.lit('"'))).alias("has_raw"))


@query
def group_lookup(spark, folder):
    return items.group_lookup(_items(spark, folder), _dictionary(spark, folder)).select("item_id", "grp_id", "grp")


@query
def ingest_recent(spark, folder):
    events = corpora.table(spark, folder, "events").where("event_type = 'click'")
    return items.ingest_recent(events, AS_OF, days=14, limit=50).select("event_id", "ts", "event_type", "loaded_at")


@query
def items_with_parent(spark, folder):
    orders, customers = (corpora.table(spark, folder, t) for t in ("orders", "customer"))
    joined = items.attach_parent(orders.select("o_orderkey", "o_custkey"), customers.select("c_custkey", "c_name"),
                                 "o_custkey", "c_custkey", "customer")
    return joined.select("o_orderkey", F.col("customer.c_name").alias("c_name"))


@query
def csv_source(spark, folder):
    path = shared_dir(spark, "labels-csv")
    articles.write_csv(corpora.table(spark, folder, "labels"), path)
    return articles.read_csv(spark, path, "doc_id BIGINT, quality INT, toxic INT")


@query
def csv_roundtrip(spark, folder):
    path = shared_dir(spark, "documents-csv")
    articles.write_csv(corpora.table(spark, folder, "documents").select("doc_id", "source", "text"), path)
    return articles.read_csv(spark, path, "doc_id BIGINT, source STRING, text STRING")


@query
def term_read(spark, folder):
    main = Main(spark, folder)
    path = shared_dir(spark, "term-day")
    store.write_by_term(main.series(), path)
    wanted = [r["term"] for r in main.top(5).collect()]
    return store.read_terms(spark, path, wanted).select("day", "grp", "term", r6("mean_prop"))


@query
def append_rows(spark, folder):
    path = shared_dir(spark, "appended")
    labels = corpora.table(spark, folder, "labels")
    store.append(labels.where("toxic = 0"), path)
    store.append(labels.where("toxic <> 0"), path)
    return spark.read.schema(labels.schema).parquet(path)


@query
def upsert_latest(spark, folder):
    events = corpora.table(spark, folder, "events").select("user_id", "event_type", "value", "ts", "event_id")
    stored, fresh = events.where("ts < '2024-01-16'"), events.where("ts >= '2024-01-16'")
    return store.merge_latest(stored, fresh, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query
def delete_by_key(spark, folder):
    toxic = corpora.table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    return store.delete_keys(corpora.document_keys(spark, folder), toxic, "doc_id").select("doc_id", "grp")


@query
def page_text(spark, folder):
    return pages.page_text(spread(corpora.table(spark, folder, "pages"), "page_id"))


@query
def page_content(spark, folder):
    return pages.page_content(spread(corpora.table(spark, folder, "pages"), "page_id"))


@query
def page_links(spark, folder):
    return pages.page_links(spread(corpora.table(spark, folder, "pages"), "page_id"), "ul > li > a")


@query
def url_fingerprint(spark, folder):
    return corpora.table(spark, folder, "pages").select("page_id", pages.fingerprint(F.col("url")).alias("key"))


@query
def failed_page_filter(spark, folder):
    marked = F.when(F.col("page_id") % 10 == 0, F.lit(f"error: {articles.FAILED_MARKER}")).when(
        F.col("page_id") % 25 != 1, F.col("html"))
    captured = corpora.table(spark, folder, "pages").select("page_id", marked.alias("text"))
    return articles.without_failed_pages(captured).select("page_id")


@query
def metadata_backfill(spark, folder):
    stored = corpora.table(spark, folder, "documents").select(
        "doc_id", F.lit(None).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return articles.backfill(stored, corpora.table(spark, folder, "labels"), "doc_id", ["quality", "toxic"])


# --- cleaning ---------------------------------------------------------------------------------------------------------


@query
def dedupe_rows(spark, folder):
    return clean.dedupe(corpora.table(spark, folder, "documents").select("source", "text"))


@query
def drop_nulls(spark, folder):
    known = items.group_lookup(_items(spark, folder), _dictionary(spark, folder))
    return clean.drop_nulls(known).select("item_id")


@query
def text_assemble(spark, folder):
    return _items(spark, folder).select("item_id", text.assemble(F.col("title"), F.col("description")).alias("text"))


@query
def group_filter(spark, folder):
    return clean.in_groups(Main(spark, folder).series(), GROUPS).select("day", "grp", "term", r6("mean_prop"))


@query
def pair_filter(spark, folder):
    return clean.pairs_touching(distance.group_distance(Ngrams(spark, folder).near), GROUPS[:2]).select("term", "g1", "g2", r6("dist"))


@query
def pair_groups(spark, folder):
    return clean.pair_groups(distance.group_distance(Ngrams(spark, folder).near))


@query
def term_groups(spark, folder):
    main = Main(spark, folder)
    return clean.distinct_groups(main.series(main.top(1)))


@query
def distinct_labels(spark, folder):
    edges = distance.term_edges(Ngrams(spark, folder).near)
    return clean.first_per(edges, "word", ["grp"]).select("word", "grp", r6("dist"))


@query
def group_doc_counts(spark, folder):
    return clean.group_doc_counts(corpora.document_keys(spark, folder))


@query
def first_n(spark, folder):
    return clean.first_n(corpora.document_keys(spark, folder), 100, "doc_id").select("doc_id")


# --- text -------------------------------------------------------------------------------------------------------------


def _counted(spark, folder, tokenizer, stop_words=(), bigrams=False):
    docs = corpora.documents(spark, folder).select("doc_id", "text")
    return terms.term_counts(terms.tokenize(docs, tokenizer, stop_words, bigrams)).withColumnRenamed("tf", "n")


@query
def tokens_word(spark, folder):
    return _counted(spark, folder, text.word_tokens)


@query
def tokens_ascii(spark, folder):
    return _counted(spark, folder, text.ascii_tokens)


@query
def tokens_min2(spark, folder):
    return _counted(spark, folder, lambda t: text.word_tokens(t, 2))


@query
def stopword_filter(spark, folder):
    return _counted(spark, folder, text.word_tokens, WITH_EXTRA)


@query
def boilerplate_filter(spark, folder):
    counts = _counted(spark, folder, text.word_tokens)
    return terms.without_terms(counts, Main(spark, folder).boilerplate).select("doc_id", "term", "n")


@query
def vocab_filter(spark, folder):
    counts = _counted(spark, folder, text.word_tokens)
    return terms.only_terms(counts, Main(spark, folder).vocab, vocab.MAX_TERMS).select("doc_id", "term", "n")


@query
def filtered_text(spark, folder):
    main = Main(spark, folder)
    shared = vocab.vocab_shared(vocab.vocab_per_group(main.stats))
    return terms.filtered_text(main.keys, main.tokenized, shared)


@query
def ngrams_1_2(spark, folder):
    return _counted(spark, folder, text.ascii_tokens, ENGLISH, bigrams=True)


@query
def term_counts(spark, folder):
    return _counted(spark, folder, text.ascii_tokens).withColumnRenamed("n", "tf")


def _plain_stats(spark, folder):
    """Of the text as it is: tokens of two characters or more, nothing taken out."""
    docs = corpora.documents(spark, folder).drop("day")
    return vocab.group_term_stats(terms.term_counts(terms.tokenize(docs, lambda t: text.word_tokens(t, 2))))


@query
def vocab_per_group(spark, folder):
    return vocab.vocab_per_group(_plain_stats(spark, folder))


@query
def vocab_shared(spark, folder):
    return vocab.vocab_shared(vocab.vocab_per_group(_plain_stats(spark, folder)))


def _common(spark, folder):
    docs, keys = corpora.documents(spark, folder), corpora.document_keys(spark, folder)
    tokenized = terms.tokenize(docs.drop("day"), text.ascii_tokens, ENGLISH)
    stats = vocab.group_term_stats(terms.term_counts(tokenized))
    return tokenized, keys, vocab.vocab_common(stats, keys)


@query
def vocab_common(spark, folder):
    return _common(spark, folder)[2].select("term")


@query
def vocab_pruned(spark, folder):
    return Main(spark, folder).vocab


@query
def tfidf(spark, folder):
    return Main(spark, folder).weights.select("doc_id", "term", r6("w"))


# --- series -----------------------------------------------------------------------------------------------------------


@query
def term_day_mean(spark, folder):
    return Main(spark, folder).series().select("day", "grp", "term", r6("mean_prop"))


def _changed(spark, folder) -> deltas.ChangingCorpus:
    """Two thirds of the documents come; the others come and toxic ones go; those come back and poor ones go. The second batch comes twice."""
    main, labels = Main(spark, folder), corpora.table(spark, folder, "labels")
    toxic, poor = labels.where("toxic = 1").select("doc_id"), labels.where("quality = 0").select("doc_id")
    corpus = deltas.ChangingCorpus(spark, shared_dir(spark, "changing"), lambda docs: terms.without_terms(
        terms.term_counts(terms.tokenize(docs, stop_words=WITH_EXTRA)), main.boilerplate))
    corpus.commit("load", main.docs.where("doc_id % 3 <> 0"))
    for _ in range(2):
        corpus.commit("more", main.docs.where("doc_id % 3 = 0"), toxic)
    corpus.commit("back", main.docs.join(toxic, "doc_id", "left_semi"), poor)
    return corpus


@query
def delta_tfidf(spark, folder):
    corpus = _changed(spark, folder)
    kept = stored(corpus.vocabulary(group_min_df=5, min_groups=2), "delta-vocabulary")
    return corpus.weights(kept, vocab.MAX_TERMS).select("doc_id", "term", r6("w"))


@query
def delta_day_mean(spark, folder):
    corpus = _changed(spark, folder)
    kept = stored(corpus.vocabulary(group_min_df=5, min_groups=2), "delta-vocabulary")
    return corpus.daily_means(kept, vocab.MAX_TERMS).select("day", "grp", "term", r6("mean_prop"))


@query
def word_trend(spark, folder):
    main = Main(spark, folder)
    return trends.word_trend(main.series(main.top(1))).select("day", "grp", "term", r6("mean_prop"), r6("rolling"))


def _words(spark, folder):
    main = Main(spark, folder)
    top = main.top(5)
    return trends.words_union(main.series(top), top)


@query
def words_union(spark, folder):
    return _words(spark, folder).select("day", "grp", "word", r6("mean_prop"))


@query
def word_proportion(spark, folder):
    return trends.word_proportion(_words(spark, folder)).select("grp", "word", r6("overall_prop"))


@query
def group_share(spark, folder):
    shares = trends.group_share(trends.word_proportion(_words(spark, folder)))
    return shares.select("grp", "word", r6("share"))


@query
def series_map_roundtrip(spark, folder):
    main = Main(spark, folder)
    series = main.series(main.top(5))
    return reshape.decode_series(reshape.encode_series(series)).select("day", "grp", "term", r6("mean_prop"))


@query
def term_rank(spark, folder):
    return ranks.term_rank(corpora.monthly_words(spark, folder))


@query
def word_rank(spark, folder):
    """Every word of every (day, source) cell by its count: words of any number, no cell in one task."""
    docs = corpora.documents(spark, folder)
    counts = terms.term_counts(terms.tokenize(docs)).groupBy("day", "grp", "term").agg(F.sum("tf").alias("n"))
    return ordinals.average_ranks(stored(counts, "word-counts"), ["day", "grp"], "n")


@query
def term_rank_ordinal(spark, folder):
    return ranks.term_rank_ordinal(corpora.monthly_words(spark, folder))


@query
def top_term(spark, folder):
    return ranks.top_term(ranks.term_rank(corpora.monthly_words(spark, folder)), WORDS)


@query
def series_align(spark, folder):
    aligned = ranks.align_series(corpora.monthly_words(spark, folder), WORDS)
    return aligned.select("day", "grp", *[r6(w) for w in WORDS])


@query
def rank_matrix(spark, folder):
    """Ranks as a matrix of words, months and regions without any rank left out, melted again to compare it."""
    wide = reshape.pivot_known(ranks.term_rank(corpora.monthly_words(spark, folder)), ["day", "grp"], "term", "rank")
    return reshape.melt(wide, ["day", "grp"], wide.columns[2:], "term", "rank").select("day", "grp", "term", "rank")


@query
def melt(spark, folder):
    aligned = ranks.align_series(corpora.monthly_words(spark, folder), WORDS)
    return reshape.melt(aligned, ["day", "grp"], WORDS).select("day", "grp", "word", r6("value"))


# --- association and distance -----------------------------------------------------------------------------------------


def _corr(main: Main, chosen: DataFrame | None = None) -> DataFrame:
    kept = stored(main.weights, "weights")
    moments = stored(assoc.term_moments(kept, main.keys, main.vocab, vocab.MAX_TERMS), "moments")
    return assoc.term_corr(kept, main.keys, main.vocab, chosen, vocab.MAX_TERMS, moments)


@query
def term_corr(spark, folder):
    return _corr(Main(spark, folder)).select("grp", "term", "other", r6("corr"))


@query
def word_correlations(spark, folder):
    main = Main(spark, folder)
    return assoc.word_correlations(_corr(main, main.top(5))).select("term", "grp", "other", r6("corr"))


@query
def term_cosine(spark, folder):
    return Ngrams(spark, folder).all_cosine.select("grp", "term", "other", r6("dist"))


@query
def term_nearest(spark, folder):
    return Ngrams(spark, folder, short=True).near.select("term", "grp", "word", r6("dist"))


@query
def term_edges_all(spark, folder):
    return distance.term_edges(Ngrams(spark, folder, short=True).near).select("term", "grp", "word", r6("dist"))


@query
def group_distance(spark, folder):
    return distance.group_distance(Ngrams(spark, folder, short=True).near).select("term", "g1", "g2", r6("dist"))


@query
def term_edges(spark, folder):
    return distance.term_edges(Ngrams(spark, folder).near).select("term", "grp", "word", r6("dist"))


@query
def graph_node_join(spark, folder):
    joined = distance.node_join(distance.term_edges(Ngrams(spark, folder).near))
    return joined.select("grp", "word", r6("dist"), "grp_degree", "word_degree")


@query
def pivot_term_vector(spark, folder):
    """The vector of a term over all of its retained words: a row a group, a column a word, unpivoted to compare it."""
    near = Ngrams(spark, folder).near
    words = sorted(r["word"] for r in near.select("word").distinct().collect())  # at most 60: the columns of the answer
    wide = reshape.pivot_vector(near, words)
    return wide.unpivot("grp", [F.col(f"`{w}`") for w in words], "word", "dist").select("grp", "word", r6("dist"))


# --- topics -----------------------------------------------------------------------------------------------------------


def _vectors(spark, folder):
    tokenized, keys, common = _common(spark, folder)
    n = vocab.corpus_size(keys)
    return topics.tfidf_vectors(tokenized, vocab.prune(common, n, 0.005, 1.0, cap=None), n)


def _model(spark, folder):
    vectors, words = _vectors(spark, folder)
    return topics.svd_topics(stored(vectors, "topic-vectors"), words)


@query
def svd_topics(spark, folder):
    return _model(spark, folder).topics.select("topic_id", r6("sigma"))


@query
def svd_components(spark, folder):
    return _model(spark, folder).components.select("topic_id", "term", r6("weight"))


@query
def doc_topic_scores(spark, folder):
    return _model(spark, folder).scores.select("doc_id", "topic_id", r6("score"))


@query
def svd_term_products(spark, folder):
    """Sums over the topics of sigma squared times two terms' weights: products of the terms' columns, whatever the signs of the topics."""
    model = _model(spark, folder)
    parts = stored(model.components.join(model.topics, "topic_id").select("topic_id", "term", (F.col("weight") * F.col("sigma")).alias("x")), "components")
    return topics.term_products(parts, len(model.terms)).select("term", "other", r6("s"))


@query
def svd_update(spark, folder):
    """The topics of one half of the documents, updated with the other: sums as in svd_energy, and how far the values and the space of
    the topics are from those of all documents at once."""
    vectors, words = _vectors(spark, folder)
    vectors = stored(vectors, "topic-vectors")
    first = topics.svd_topics(vectors.where("doc_id % 2 = 0"), words)
    both = topics.update_topics(first, vectors.where("doc_id % 2 = 1"))
    gaps = topics.model_gaps(both, topics.svd_topics(vectors, words))
    square = F.col("sigma") * F.col("sigma")
    return both.topics.agg(r6(F.sum(square), "squares"), F.round(F.sum(square * square), 3).alias("fourths"),
                           *(F.round(F.lit(gap), 6).alias(name) for name, gap in gaps.items()))


@query
def topic_documents(spark, folder):
    """From texts to a report: every topic of the documents, its name, and the documents that carry it most, with title and place."""
    model, docs = _model(spark, folder), corpora.documents(spark, folder)
    best = topics.top_topics(model.vectors, model)
    report = topics.topic_report(best, topics.topic_labels(topics.topic_terms(model.components)), model.topics)
    titles = docs.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return report.join(titles, "doc_id").select("topic_id", "label", r6("sigma"), "place", "doc_id", "grp", "title", r6("score"))


@query
def svd_energy(spark, folder):
    """Sums over the topics, and over the scores of the documents, that the vectors alone determine if all topics are kept."""
    model = _model(spark, folder)
    of_scores = model.scores.agg(F.sum(F.col("score") * F.col("score")).alias("e"))
    square = F.col("sigma") * F.col("sigma")
    return model.topics.agg(r6(F.sum(square), "squares"), F.round(F.sum(square * square), 3).alias("fourths"),
                            r6(of_scores.scalar(), "score_squares"))


@query
def svd_residual(spark, folder):
    """How far the topics are from being orthonormal, and the squared scores of a topic from its sigma squared: both 0."""
    model = _model(spark, folder)
    parts = stored(model.components, "components")
    left = parts.select(F.col("topic_id").alias("i"), "term", F.col("weight").alias("x"))
    products = left.join(parts.select(F.col("topic_id").alias("j"), "term", F.col("weight").alias("y")), "term").groupBy("i", "j").agg(
        F.sum(F.col("x") * F.col("y")).alias("s"))
    skew = products.agg(F.max(F.abs(F.col("s") - (F.col("i") == F.col("j")).cast("double"))).alias("skew"))
    sums = model.scores.groupBy("topic_id").agg(F.sum(F.col("score") * F.col("score")).alias("e")).join(model.topics, "topic_id")
    gap = sums.agg(F.max(F.abs(F.col("e") - F.col("sigma") * F.col("sigma"))).alias("gap"))
    return skew.select(r6("skew"), r6(gap.scalar(), "gap"))


# The read side of the topics works on any tables of scores and components. These can be built in SQL as well: the positions
# of the embeddings are topics and their values scores; the groups' summed weights of terms are components.


def _scores(spark, folder):
    vectors = corpora.table(spark, folder, "embeddings")
    return vectors.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("grp"),
                          F.posexplode(F.col("embedding").cast("array<double>")).alias("topic_id", "score"))


def _score_topics(spark, folder):
    return _scores(spark, folder).groupBy("topic_id").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("sigma"))


def _group_terms(spark, folder):
    """Components and topics of the groups, and the term lists made of them."""
    rows = Main(spark, folder).weights.select(F.substring("grp", 4, 9).cast("int").alias("topic_id"), "term", "w")
    parts = stored(rows.groupBy("topic_id", "term").agg(F.sum("w").alias("weight")), "group-terms")
    found = parts.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("sigma"))
    return topics.topic_terms(parts), found


@query
def topic_terms(spark, folder):
    return _group_terms(spark, folder)[0].select("topic_id", "term", r6("weight"), "pos")


@query
def topics_with_term(spark, folder):
    listed, _ = _group_terms(spark, folder)
    held = listed.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(1)
    return topics.topics_with_term(listed, held).select("topic_id", "term", r6("weight"))


@query
def topic_rows(spark, folder):
    rows = topics.topic_rows(topics.encode_topics(*_group_terms(spark, folder)))
    return rows.select("topic_id", "term", r6("value"), r6("sigma"))


@query
def topic_composition(spark, folder):
    rows = topics.topic_rows(topics.encode_topics(*_group_terms(spark, folder)))
    return topics.topic_composition(rows).select("topic_id", "term", r6("share"))


@query
def topic_labels(spark, folder):
    return topics.topic_labels(_group_terms(spark, folder)[0])


@query
def topic_scores(spark, folder):
    one = topics.scores_of_topic(_scores(spark, folder), _score_topics(spark, folder), 3)
    return one.select("doc_id", "grp", "topic_id", r6("score"), r6("sigma"))


def _top_topics(spark, folder):
    return topics.doc_top_topics(topics.sigma_weighted(_scores(spark, folder), _score_topics(spark, folder)))


@query
def doc_top_topics(spark, folder):
    return _top_topics(spark, folder).select("doc_id", "grp", "topic_id", r6("score"), "pos")


@query
def topic_top_docs(spark, folder):
    return topics.topic_top_docs(_top_topics(spark, folder), 0).select("doc_id", "topic_id", r6("score"))


def _label_scores(spark, folder):
    labels = corpora.table(spark, folder, "labels").unpivot("doc_id", ["quality", "toxic"], "topic_id", "score")
    sources = corpora.document_keys(spark, folder)
    return labels.join(sources, "doc_id").select("topic_id", "grp", F.col("score").cast("double").alias("score"))


@query
def topic_group_diff(spark, folder):
    pairs = compare.topic_group_diff(_label_scores(spark, folder))
    return pairs.select("topic_id", "g1", "g2", r6("meandiff"), r6("se"), r6("q"), F.round("p_adj", 4).alias("p_adj"),
                        F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "reject")


@query
def topic_group_distance(spark, folder):
    gaps = compare.topic_group_diff(_scores(spark, folder))
    return compare.topic_group_distance(gaps, _score_topics(spark, folder)).select("topic_id", "g1", "g2", r6("dist"))


@query
def score_density(spark, folder):
    events = corpora.table(spark, folder, "events").select(F.col("event_type").alias("grp"), F.col("value").alias("score"))
    return compare.score_density(events).select("grp", "bin", r6("density"))


@query
def score_kernel_density(spark, folder):
    events = corpora.table(spark, folder, "events").select(F.col("event_type").alias("grp"), F.col("value").alias("score"))
    return compare.kernel_density(events).select("grp", "point", r6("x"), r6("density"))


# --- scalars and streams ----------------------------------------------------------------------------------------------


@query
def date_format_roundtrip(spark, folder):
    days = corpora.table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    label = dates.day_label(F.col("day"))
    return days.select("day", label.alias("label"), dates.parse_label(label).alias("parsed"))


@query
def json_field_extract(spark, folder):
    parsed = F.from_json("props", "k INT")
    return corpora.table(spark, folder, "events").select("event_id", parsed["k"].alias("k"))


@query
def stream_upsert(spark, folder):
    """Several deliveries: the newest rows first, then the oldest, then the others, and some of them twice."""
    events = corpora.table(spark, folder, "events").select("user_id", "event_type", "value", "ts", "event_id")
    path = shared_dir(spark, "deliveries")
    for part in ("ts >= '2024-01-21'", "ts < '2024-01-06'", "ts >= '2024-01-06' AND ts < '2024-01-21'", "ts < '2024-01-03'"):
        store.append(events.where(part), f"{path}/events.parquet")
    stream = refresh.stream_table(spark, path, "events", files_per_batch=1)
    return refresh.stream_upsert(stream, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query
def stream_daily(spark, folder):
    stream = refresh.stream_table(spark, folder, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    daily = refresh.daily_statistics(stream, "event_type", "value")
    return refresh.run_to_table(daily).select("day", "event_type", "n", "avg_value")
