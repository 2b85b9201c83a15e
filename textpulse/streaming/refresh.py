"""Incremental refresh: keyed upsert and daily statistics on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.session import shared_dir
from textpulse.sources.store import merge_latest


BUCKETS = 32
_MANIFEST = "bucket int, version long"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """One parquet table of a shared folder as a stream, with the schema its files already have.

    The table is one file, or with ``files_per_batch`` a folder of files that are taken in the order of their arrival.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        return reader.option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_upsert(stream: DataFrame, keys: list[str], version: list[str], target: str | None = None,
                  buckets: int = BUCKETS) -> DataFrame:
    """Fold a stream into a snapshot, field by field and newest first, and return the newest snapshot.

    Every row counts, however late: the merge keeps the newest value of each field, so order and repeated deliveries do not
    matter and nothing has to be dropped. Keys are dealt to ``buckets``; batch ``n`` rewrites the buckets that it touches
    as version ``n`` and writes a manifest of the version of every bucket. A batch that is repeated after a failure, or a
    restart on the same ``target``, writes the same files again. Files that neither of the two newest manifests names go.
    """
    spark = stream.sparkSession
    base = target or shared_dir(spark, "upsert")
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def manifest(n: int) -> dict[int, int]:
        if n < 0:
            return {}
        rows = spark.read.schema(_MANIFEST).parquet(f"{base}/manifest/v{n}").collect()  # at most one a bucket
        return {r["bucket"]: r["version"] for r in rows}

    def merge(batch: DataFrame, n: int) -> None:
        now = manifest(n - 1)
        fresh = batch.withColumn("bucket", place)
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
        known = [f"{base}/data/v{now[b]}/bucket={b}" for b in touched if b in now]
        if touched:
            plain = fresh.drop("bucket")
            stored = spark.read.schema(plain.schema).parquet(*known) if known else plain.limit(0)
            merged = merge_latest(stored, plain, keys, version).withColumn("bucket", place)
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/data/v{n}")
        after = now | {b: n for b in touched}
        spark.createDataFrame(list(after.items()), _MANIFEST).write.mode("overwrite").parquet(f"{base}/manifest/v{n}")
        spark.createDataFrame([(n,)], "batch long").write.mode("overwrite").parquet(f"{base}/done/v{n}")
        if n > 1:
            past = manifest(n - 2)
            _remove(spark, [f"{base}/data/v{v}/bucket={b}" for b, v in past.items() if v not in (now.get(b), after.get(b))]
                    + [f"{base}/manifest/v{n - 2}"])

    query = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    last = spark.read.schema("batch long").parquet(f"{base}/done/*").agg(F.max("batch")).first()[0]
    files = [f"{base}/data/v{v}/bucket={b}" for b, v in sorted(manifest(last).items())]
    schema = stream.schema
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(conf).delete(there, True)


def daily_statistics(events: DataFrame, grp: str, value: str, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Count, total and mean per day and group. Rows later than the watermark do not count; tables work as well."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, "1 day").alias("_w"), grp).agg(
        F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.to_date("_w.start").alias("day"), grp, "n", "total", (F.col("total").cast("double") / F.col("n")).alias("avg_value"))


def run_to_table(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all available input in append mode and return what it wrote: final results only."""
    spark = stream.sparkSession
    out = shared_dir(spark, "stream")
    query = (stream.writeStream.outputMode("append").format("parquet")
             .option("checkpointLocation", checkpoint or shared_dir(spark, "stream-state"))
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
