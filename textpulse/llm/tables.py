"""Tables of a folder, and intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textpulse.llm.buffers import collect_vectors, mix, summed_vectors
from textpulse.session import shared_dir

BATCH_BYTES = 1 << 22
BITS = 1 << 23  # 1 MB; as it fills up, more rows pass that an exact join then drops


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python ``BATCH_BYTES`` at a time, or one by one if longer.

    A batch lies in memory several times, outside the heap of the executor and in its Python worker; Spark's own limit of 64 MB
    lets a few concurrent tasks on long texts hold hundreds of them.
    """
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _places(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)
    return (h >> np.uint64(6)).astype(np.int64), h & np.uint64(63)


def bit_table(ids: DataFrame, bits: int = BITS) -> np.ndarray:
    """A table of hashed ids (one bigint column, no nulls), of fixed size: what is not in it is not among ``ids``."""
    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        seen = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            cell, bit = _places(batch.column(0), bits)
            np.bitwise_or.at(seen, cell, np.uint64(1) << bit)
        return {"": seen.view(np.int64)}

    found = collect_vectors(summed_vectors(ids, count, bits // 64, union=True), bits // 64, 1)
    return found.get("", np.zeros(bits // 64, np.int64)).view(np.uint64)


def may_be_in(batch: pa.RecordBatch, key: str, seen: np.ndarray) -> np.ndarray:
    """Flags of the rows whose ``key`` may be among the ids of the table."""
    cell, bit = _places(batch.column(key), len(seen) * 64)
    return ((seen[cell] >> bit) & np.uint64(1)).astype(bool)


def in_bit_table(df: DataFrame, key: str, seen: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows whose ``key`` may be among the ids of the table, or those that certainly are not."""
    table = df.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = may_be_in(batch, key, table.value)
            yield batch.filter(pa.array(hit if inside else ~hit))

    return df.mapInArrow(run, df.schema)
