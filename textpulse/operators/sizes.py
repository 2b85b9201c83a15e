"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int | None) -> DataFrame:
    """Hint a broadcast if ``rows``, a cap or a count of ``df``, is small; otherwise leave the join to Spark.

    Without a hint Spark decides by size statistics and, while running, by measured sizes; skewed keys of a shuffle
    join are split by adaptive execution.
    """
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df
