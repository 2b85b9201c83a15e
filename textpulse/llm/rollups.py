r"""Token counts kept as rollups that batches of signed changes update.

A change is one row (doc_id, source, lang, version, n_docs, n_tokens) with a sign: an insert counts +1 document and
+n tokens, a delete -1 and -n, a revision is the delete of the old count and the insert of the new one. A batch is summed
by (source, lang, tokenizer version) before it is shuffled and stored under its id; totals are the sums of all committed
batches. Additive, so the order of batches does not matter.

Committing is idempotent: a batch is written to its own folder first and named in the commit log afterwards. A batch that
is delivered again after its commit changes nothing; one that failed in between is overwritten by its retry, and readers
never see it. ``compact`` folds committed batches into one.

Defined results: a null text has 0 tokens and counts as a document; null sources and languages are groups of their own;
repeated rows count each; groups without a document and without tokens are left out of the totals; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tokenizer versions: regular expressions of their tokens.
VERSIONS = {"space-1": r"[^\x20\x09-\x0D]+", "word-1": r"[A-Za-z0-9]+"}
KEYS = ["source", "lang", "version"]
TOTALS = ["n_docs", "n_tokens"]
BATCH_SCHEMA = "source string, lang string, version string, n_docs bigint, n_tokens bigint, batch string"


def counted(docs: DataFrame, versions: dict[str, str] = VERSIONS, text: str = "text") -> DataFrame:
    """The insert of every document under every tokenizer version."""
    def count(pattern: str) -> Column:
        return F.coalesce(F.regexp_count(F.col(text), F.lit(pattern)), F.lit(0)).cast("bigint")
    rows = docs.select("doc_id", "source", "lang", *(count(p).alias(f"_{v}") for v, p in versions.items()))
    each = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(1).cast("bigint").alias("n_docs"),
                              F.col(f"_{v}").alias("n_tokens")) for v in versions))
    return rows.select("doc_id", "source", "lang", F.inline(each))


def negated(changes: DataFrame) -> DataFrame:
    """The deletes that take ``changes`` back."""
    return changes.withColumns({c: -F.col(c) for c in TOTALS})


class Rollup:
    """Totals under ``path``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self) -> set[str]:
        """Ids in the commit log, which holds a row a batch since the last compaction."""
        try:
            return {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/commits/*").collect()}
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return set()
            raise

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; False if its id was committed before."""
        if batch in self._committed():
            return False
        sums = changes.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in TOTALS)).withColumn("batch", F.lit(batch))
        sums.write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        self._log(batch, [batch])
        return True

    def _log(self, name: str, batches: list[str]) -> None:
        log = self.spark.range(len(batches), numPartitions=1).select(F.get(F.lit(batches), F.col("id").cast("int")).alias("batch"))
        log.write.mode("overwrite").parquet(f"{self.path}/commits/{name}")

    def totals(self) -> DataFrame:
        done = self._committed()
        if not done:
            return self.spark.createDataFrame([], BATCH_SCHEMA).drop("batch")
        deltas = self.spark.read.schema(BATCH_SCHEMA).parquet(*(f"{self.path}/deltas/{b}" for b in sorted(done)))
        sums = deltas.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in TOTALS))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, into: str) -> "Rollup":
        """The same totals and batch ids in a new folder, as a single batch of sums."""
        done = sorted(self._committed())
        new = Rollup(self.spark, into)
        base = f"compacted-{len(done)}"
        self.totals().withColumn("batch", F.lit(base)).write.mode("overwrite").parquet(f"{new.path}/deltas/{base}")
        for b in done:  # known ids without a delta of their own
            self.totals().limit(0).withColumn("batch", F.lit(b)).write.mode("overwrite").parquet(f"{new.path}/deltas/{b}")
        new._log(base, [base, *done])
        return new
