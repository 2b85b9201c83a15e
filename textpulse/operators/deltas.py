"""Vocabulary, weights and daily means of a corpus that changes by batches.

A batch brings documents or takes them away, by a sign. What costs most, the tokenising, is done once for a document that comes; one that
goes is counted from what was stored when it came. A batch appends three small tables under its own name: signed counts by
(document, term), and their signed sums by (group, term) and by (day, group). Sums are what vocabulary, document frequencies and
denominators are made of, so those never read the corpus again, and only the terms and cells that a batch touches get new rows.

Weights divide by norms that depend on every document frequency and on the number of documents, so they are derived, when asked, from the
stored counts of the terms that the vocabulary keeps, without a text or a token.

A batch is written under a temporary name first and then named, so it counts as a whole or not at all; a batch of a name that is
there is left as it is, and so a repeated delivery changes nothing. Defined results: a document that goes without having come, or a second
time, is ignored; one that comes again while it is there is ignored too; within a batch each id counts once, and what leaves is what was
there before the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.operators import trends, vocab, weights
from textpulse.operators.sizes import small


class ChangingCorpus:
    """``tokenizer`` turns ``docs(doc_id, grp, day, text)`` into counts ``(doc_id, grp, day, term, tf)``; every document must have been seen by the same one."""

    def __init__(self, spark: SparkSession, path: str, tokenizer):
        self.spark, self.path, self.tokenizer = spark, path.rstrip("/"), tokenizer

    def _exists(self, path: str):
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), there

    def _read(self, name: str) -> DataFrame | None:
        files, place = self._exists(f"{self.path}/batches")
        if not files.exists(place) or not files.listStatus(place):
            return None
        return self.spark.read.parquet(f"{self.path}/batches/*/{name}")

    def _live_docs(self) -> DataFrame | None:
        """Documents that have come and not gone: ``(doc_id, grp, day)``, one row each."""
        docs = self._read("docs")
        return None if docs is None else docs.groupBy("doc_id", "grp", "day").agg(F.sum("sign").alias("_n")).where("_n > 0").drop("_n")

    def commit(self, name: str, arriving: DataFrame | None = None, leaving: DataFrame | None = None) -> bool:
        """Apply a batch; ``leaving`` holds ``doc_id``. False if a batch of that name was applied before."""
        files, final = self._exists(f"{self.path}/batches/{name}")
        if files.exists(final):
            return False
        draft = f"{self.path}/drafts/{name}"
        live = self._live_docs()
        docs, counts = [], []
        if arriving is not None:
            new = arriving.dropDuplicates(["doc_id"])
            new = new if live is None else new.join(live.select("doc_id"), "doc_id", "left_anti")
            counts.append(self.tokenizer(new).withColumn("sign", F.lit(1)))
            docs.append(new.select("doc_id", "grp", "day", F.lit(1).alias("sign")))
        if leaving is not None and live is not None:
            gone = live.join(leaving.select("doc_id").distinct(), "doc_id", "left_semi")
            docs.append(gone.select("doc_id", "grp", "day", F.lit(-1).alias("sign")))
            counts.append(self._live_counts(gone.select("doc_id"), "doc_id").withColumn("sign", F.lit(-1)))
        if not docs:
            return False
        columns = ["doc_id", "grp", "day", "term", "tf", "sign"]
        self._union(counts, columns).write.mode("overwrite").parquet(f"{draft}/counts")
        self._union(docs, ["doc_id", "grp", "day", "sign"]).write.mode("overwrite").parquet(f"{draft}/docs")
        written = self.spark.read.parquet(f"{draft}/counts")
        sums = written.groupBy("grp", "term").agg(F.sum("sign").alias("df"), F.sum(F.col("sign") * F.col("tf")).alias("cf"))
        sums.write.mode("overwrite").parquet(f"{draft}/stats")
        files.mkdirs(final.getParent())
        if not files.rename(self._exists(draft)[1], final):
            raise RuntimeError(f"batch {name} could not be named")
        return True

    @staticmethod
    def _union(parts: list[DataFrame], columns: list[str]) -> DataFrame:
        out = parts[0].select(columns)
        for p in parts[1:]:
            out = out.unionByName(p.select(columns))
        return out

    def _live_counts(self, chosen: DataFrame, on: str) -> DataFrame:
        """Counts of the chosen documents or terms; only those are shuffled to sum their signs."""
        counts = self._read("counts").join(chosen, on, "left_semi")
        counts = counts.groupBy("doc_id", "grp", "day", "term", "tf").agg(F.sum("sign").alias("_n"))
        return counts.where("_n > 0").drop("_n")

    def keys(self) -> DataFrame:
        """``(doc_id, grp, day)`` of the documents that are there."""
        return self._live_docs()

    def statistics(self) -> DataFrame:
        """``(grp, term, df, cf)`` of the documents that are there, from the batches' sums."""
        return self._read("stats").groupBy("grp", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")

    def vocabulary(self, **limits) -> DataFrame:
        return vocab.vocab_pruned(self.statistics(), vocab.corpus_size(self.keys()), **limits)

    def weights(self, kept: DataFrame, rows: int | None = None) -> DataFrame:
        """``(doc_id, grp, day, term, w)`` of the terms of ``kept``; ``rows`` is its cap or count, if known."""
        counts = self._live_counts(small(kept.select("term"), rows), "term")
        return weights.tfidf(counts, kept, vocab.corpus_size(self.keys()), vocab_rows=rows)

    def daily_means(self, kept: DataFrame, rows: int | None = None) -> DataFrame:
        return trends.term_day_mean(self.weights(kept, rows), self.keys(), kept)
