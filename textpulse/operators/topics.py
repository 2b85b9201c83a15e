"""Latent topics: truncated SVD of the TF-IDF matrix and its read side."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpulse.functions.numeric import tie_safe
from textpulse.operators import svd
from textpulse.operators.weights import idf

MAX_TOPICS = 400
TERMS_PER_TOPIC = 5
TOPICS_PER_DOC = 10
SCORED_DOCS = 256  # multiplied at once: 256 documents of 100 terms and 400 topics are 80 MB
PRODUCT_TERMS = 512  # of a block: a pair of blocks of 400 topics is 3 MB and makes 262,144 products

_TOPICS = "topic_id int, sigma double"
_COMPONENTS = "topic_id int, term string, weight double"


@dataclass
class TopicModel:
    """``topics(topic_id, sigma)``, ``components(topic_id, term, weight)``, ``scores(doc_id, grp, topic_id, score)``.

    ``terms``, ``sigma`` and ``loadings`` are the same in the driver's memory, for an update or for scores of other documents;
    ``vectors`` are the documents that the scores belong to.
    """

    topics: DataFrame
    components: DataFrame
    scores: DataFrame
    terms: list[str] = field(default_factory=list)
    sigma: np.ndarray = field(default_factory=lambda: np.zeros(0))
    loadings: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    vectors: DataFrame | None = None


def tfidf_vectors(tokenized: DataFrame, vocab: DataFrame, n_docs: Column, key: str = "doc_id"
                  ) -> tuple[DataFrame, list[str]]:
    """One sparse TF-IDF vector per document, built where the document lies: no shuffle.

    The vocabulary obeys a relative document-frequency rule, which bounds its size by the mean document length and not
    by the number of documents. The driver holds it, as in every Spark ML model of words.
    """
    rows = idf(vocab, n_docs).orderBy("term").collect()
    terms = [r["term"] for r in rows]
    if not terms:
        return tokenized.select(key, "grp"), terms
    stages = PipelineModel([
        CountVectorizerModel.from_vocabulary(terms, "tokens", "_tf"),
        ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="_tf", outputCol="_x"),
        Normalizer(p=2.0, inputCol="_x", outputCol="features"),
    ])
    return stages.transform(tokenized).select(key, "grp", "features"), terms


def svd_topics(vectors: DataFrame, terms: list[str], k: int = MAX_TOPICS, key: str = "doc_id") -> TopicModel:
    """The ``k`` strongest topics (at most one per term), each signed so that its largest loading is positive.

    ``vectors`` are read by the solver until the topics are exact and again for the scores, so store them first. The driver holds
    the vocabulary and the solver's basis, whose size is checked; components and scores are made of the broadcast loadings by tasks.
    """
    if not terms:
        return _model(vectors, terms, np.zeros(0), np.zeros((0, 0)), key)
    return _model(vectors, terms, *svd.truncated(vectors.select("features"), len(terms), k), key)


def update_topics(model: TopicModel, fresh: DataFrame, k: int = MAX_TOPICS, key: str = "doc_id") -> TopicModel:
    """The model of the old documents and of ``fresh`` ones, with vectors over the same terms; old documents are not read.

    Its scores are those of the fresh documents. The result is that of the whole if the old model kept all topics; with fewer, what
    was left out of it stays out. Weights are those the vocabulary had when the model was made.
    """
    if not model.terms:
        return _model(fresh, [], np.zeros(0), np.zeros((0, 0)), key)
    return _model(fresh, model.terms, *svd.updated(model.sigma, model.loadings, fresh.select("features"), k), key)


def _model(vectors: DataFrame, terms: list[str], sigma: np.ndarray, loadings: np.ndarray, key: str) -> TopicModel:
    spark = vectors.sparkSession
    if not terms:
        kind = vectors.schema[key].dataType.simpleString()
        return TopicModel(*[spark.createDataFrame([], s) for s in (
            _TOPICS, _COMPONENTS, f"{key} {kind}, grp string, topic_id int, score double")], vectors=vectors)
    topics = spark.createDataFrame([(i, float(s)) for i, s in enumerate(sigma)], _TOPICS)
    return TopicModel(topics, _components(spark, terms, loadings), document_scores(vectors, loadings, key), terms, sigma, loadings, vectors)


def _components(spark: SparkSession, terms: list[str], loadings: np.ndarray) -> DataFrame:
    """``(topic_id, term, weight)``: a map over the numbers of the terms, with terms and loadings broadcast."""
    shared = spark.sparkContext.broadcast((np.array(terms, dtype=object), loadings))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, weights = shared.value
        k = weights.shape[1]
        for pdf in batches:
            at = pdf["id"].to_numpy()
            yield pd.DataFrame({"topic_id": np.tile(np.arange(k, dtype="int32"), len(at)), "term": np.repeat(names[at], k),
                                "weight": weights[at].ravel()})

    return spark.range(len(terms)).mapInPandas(rows, _COMPONENTS)


def document_scores(vectors: DataFrame, loadings: np.ndarray, key: str = "doc_id") -> DataFrame:
    """Each document's vector times V, one row per topic: a map over Arrow batches, without a shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(loadings)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # A vector column arrives as its parts; sparse ones name the positions of their values.
            parts = [(np.arange(len(v["values"])) if v["indices"] is None else v["indices"], v["values"]) for v in pdf["features"]]
            scores = np.zeros((len(parts), shared.value.shape[1]))
            used = np.array([i for i, (at, _) in enumerate(parts) if len(at)], dtype=int)
            for lo in range(0, len(used), SCORED_DOCS):
                some = used[lo:lo + SCORED_DOCS]
                starts = np.cumsum([0, *(len(parts[i][0]) for i in some[:-1])])
                at, values = (np.concatenate([parts[i][j] for i in some]) for j in (0, 1))
                scores[some] = np.add.reduceat(shared.value[at] * values[:, None], starts, axis=0)
            yield pd.DataFrame({key: pdf[key], "grp": pdf["grp"], "_scores": list(scores)})

    kind = vectors.schema[key].dataType.simpleString()
    wide = vectors.select(key, "grp", "features").mapInPandas(project, f"{key} {kind}, grp string, _scores array<double>")
    return wide.select(key, "grp", F.posexplode("_scores").alias("topic_id", "score"))


def model_gaps(a: TopicModel, b: TopicModel) -> dict[str, float]:
    """Largest difference of two models' sigmas, and the sine of the largest angle between the spaces of their topics."""
    if not len(a.sigma) or not len(b.sigma):
        return {"sigma_gap": 0.0, "angle": 0.0}
    n = min(len(a.sigma), len(b.sigma))
    outside = a.loadings[:, :n] - b.loadings[:, :n] @ (b.loadings[:, :n].T @ a.loadings[:, :n])
    return {"sigma_gap": float(np.abs(a.sigma[:n] - b.sigma[:n]).max()), "angle": float(np.linalg.norm(outside, 2))}


def top_topics(vectors: DataFrame, model: TopicModel, n: int = TOPICS_PER_DOC, key: str = "doc_id") -> DataFrame:
    """``doc_top_topics`` of the sigma-weighted scores, without the table of all scores: ``n`` rows a document leave the task.

    Topics are read in the order of their sigma, some at a time. What a document's vector holds outside the topics read so far
    bounds its score on each later one, times sigma; a document stops when that cannot reach its n-th best. A document without a
    kept term scores 0 on all topics, as in the full table.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, grp string, _best array<struct<topic_id int, score double>>"
    if not model.terms:
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, grp string, topic_id int, score double, pos int")
    shared = vectors.sparkSession.sparkContext.broadcast((model.sigma, model.loadings))
    names = ["topic_id", "score"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigma, loadings = shared.value
        for batch in batches:
            topic = np.tile(np.arange(min(n, len(sigma)), dtype=np.int32), (len(batch), 1))
            score = np.zeros(topic.shape)
            for rows, used, dense in svd.pieces(iter([pa.RecordBatch.from_arrays([batch.column(2)], ["features"])])):
                topic[rows], score[rows] = _threshold(dense, sigma, loadings[used], topic.shape[1])
            flat = pa.StructArray.from_arrays([pa.array(topic.ravel()), pa.array(score.ravel())], names)
            bounds = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * topic.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(bounds, flat)], [key, "grp", "_best"])

    found = vectors.select(key, "grp", "features").mapInArrow(best, schema)
    rows = found.select(key, "grp", F.posexplode("_best").alias("pos", "_b"))
    return rows.select(key, "grp", "_b.topic_id", "_b.score", (F.col("pos") + 1).alias("pos"))


def _threshold(x: np.ndarray, sigma: np.ndarray, loadings: np.ndarray, n: int, step: int = 2 * TOPICS_PER_DOC) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` highest sigma-weighted scores of each row and their topics; equal to nine digits, the smaller topic comes first."""
    scores = np.full((len(x), len(sigma)), -np.inf)
    left, open_ = (x * x).sum(axis=1), np.arange(len(x))
    for lo in range(0, len(sigma), step):
        part = x[open_] @ loadings[:, lo:lo + step]
        scores[open_, lo:lo + step] = part * sigma[lo:lo + step]
        left[open_] -= (part * part).sum(axis=1)
        if lo + step < len(sigma) and lo + step >= n:
            nth = np.partition(scores[open_], len(sigma) - n, axis=1)[:, len(sigma) - n]
            open_ = open_[sigma[lo + step] * np.sqrt(np.maximum(left[open_], 0) + 1e-12) >= nth - 1e-8]
            if not len(open_):
                break
    order = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :n]
    return order.astype(np.int32), np.take_along_axis(scores, order, axis=1)


def topic_report(top: DataFrame, labels: DataFrame, topics: DataFrame, n: int = TOPICS_PER_DOC, key: str = "doc_id") -> DataFrame:
    """Topics with their names and sigmas and the ``n`` documents that score highest among those that kept the topic."""
    order = Window.partitionBy("topic_id").orderBy(F.desc(tie_safe(F.col("score"))), key)
    first = top.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return first.join(F.broadcast(labels.join(topics, "topic_id")), "topic_id").select("topic_id", "label", "sigma", "place", key, "grp", "score")


def term_products(parts: DataFrame, n_terms: int) -> DataFrame:
    """``(term, other, s)``: products of the vectors ``x`` over the topics of all pairs of terms, each with itself included.

    ``parts(topic_id, term, x)`` holds ``n_terms`` terms, each with all topics. Terms are dealt to blocks, and a task multiplies two
    blocks as matrices: what is shuffled is a term's vector once for each block, and not a row for each pair of terms and topic.
    """
    blocks = max(1, -(-n_terms // PRODUCT_TERMS))
    entries = F.sort_array(F.collect_list(F.struct("topic_id", "x")))
    vectors = parts.groupBy("term").agg(entries.alias("_v")).select("term", F.col("_v.x").alias("x"), F.pmod(F.hash("term"), F.lit(blocks)).alias("_b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = vectors.select("term", "x", F.col("_b").alias("_i"), every.alias("_j"))
    right = vectors.select(F.col("term").alias("other"), F.col("x").alias("y"), every.alias("_k"), F.col("_b").alias("_l"))

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"term": [], "other": [], "s": []})
        s = np.stack(a["x"].to_list()) @ np.stack(b["y"].to_list()).T
        return pd.DataFrame({"term": np.repeat(a["term"].to_numpy(), len(b)), "other": np.tile(b["other"].to_numpy(), len(a)), "s": s.ravel()})

    return left.groupBy("_i", "_j").cogroup(right.groupBy("_k", "_l")).applyInPandas(multiply, "term string, other string, s double")


def topic_terms(components: DataFrame, n: int = TERMS_PER_TOPIC) -> DataFrame:
    """The ``n`` highest signed loadings per topic; ``pos`` ascends with the weight, as the report lists them."""
    order = Window.partitionBy("topic_id").orderBy(F.desc(tie_safe(F.col("weight"))), "term")
    best = components.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n)
    last = F.max("_place").over(Window.partitionBy("topic_id"))
    return best.select("topic_id", "term", "weight", (last - F.col("_place") + 1).cast("int").alias("pos"))


def topics_with_term(terms: DataFrame, term: str | DataFrame) -> DataFrame:
    """Topics whose term list holds the term, by its weight there."""
    held = (terms.join(term.select("term"), "term", "left_semi") if isinstance(term, DataFrame)
            else terms.where(F.col("term") == term))
    return held.select("topic_id", "term", "weight").orderBy(F.desc("weight"), "topic_id")


def topic_by_id(topics: DataFrame, topic_id: int) -> DataFrame:
    return topics.where(F.col("topic_id") == topic_id)


def encode_topics(terms: DataFrame, topics: DataFrame) -> DataFrame:
    """Topic documents: one map term -> weight per topic, with the sigma."""
    entry = F.struct("term", "weight")
    maps = terms.groupBy("topic_id").agg(F.map_from_entries(F.collect_list(entry)).alias("terms"))
    return maps.join(topics, "topic_id")


def topic_rows(encoded: DataFrame, reserved: tuple[str, ...] = ("_TOPIC", "_SIGMA")) -> DataFrame:
    """Topic documents as (topic, term, value, sigma) rows; reserved keys are no terms."""
    rows = encoded.select("topic_id", "sigma", F.explode("terms").alias("term", "value"))
    return rows.where(~F.col("term").isin(*reserved)).select("topic_id", "term", "value", "sigma")


def topic_composition(rows: DataFrame) -> DataFrame:
    """Each term's part of its topic's bar, filled to 1."""
    total = F.sum("value").over(Window.partitionBy("topic_id"))
    return rows.select("topic_id", "term", F.try_divide("value", total).alias("share"))


def topic_labels(terms: DataFrame) -> DataFrame:
    """The topic's terms, in list order, joined by dashes."""
    listed = terms.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("_t"))
    return listed.select("topic_id", F.array_join(F.col("_t.term"), "-").alias("label"))


def scores_of_topic(model_scores: DataFrame, topics: DataFrame, topic_id: int) -> DataFrame:
    """All documents' scores on one topic, with the topic's sigma attached."""
    return topic_by_id(model_scores, topic_id).join(topic_by_id(topics, topic_id), "topic_id")


def sigma_weighted(scores: DataFrame, topics: DataFrame) -> DataFrame:
    """Scores (already scaled by sigma) times sigma again. The topic table has at most ``MAX_TOPICS`` rows."""
    return scores.join(F.broadcast(topics), "topic_id").withColumn("score", F.col("score") * F.col("sigma")).drop("sigma")


def doc_top_topics(weighted: DataFrame, n: int = TOPICS_PER_DOC, key: str = "doc_id") -> DataFrame:
    """The ``n`` topics with the highest signed score per document."""
    order = Window.partitionBy(key).orderBy(F.desc(tie_safe(F.col("score"))), "topic_id")
    ranked = weighted.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)
    return ranked.select(key, "grp", "topic_id", "score", "pos")


def topic_top_docs(top_topics: DataFrame, topic_id: int, n: int = 10, key: str = "doc_id") -> DataFrame:
    """Of the documents that kept the topic, the ``n`` with the highest score."""
    kept = topic_by_id(top_topics, topic_id)
    return kept.orderBy(F.desc(tie_safe(F.col("score"))), key).limit(n).select(key, "grp", "topic_id", "score")
