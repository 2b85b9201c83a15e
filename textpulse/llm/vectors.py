"""Vectors as whole numbers: the rows that take part, and their components as numpy arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, ``x`` as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def usable(vector: Column, most: float = math.inf) -> Column:
    """No null vector, no null or non-finite component, and none of an absolute value of ``most`` or more."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < most)), F.lit(False))


def width(df: DataFrame, vector: str) -> int:
    """Components of the longest vector; shorter ones count as filled up with zeros."""
    return df.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]


def matrix(column: pa.Array, columns: int) -> np.ndarray:
    """Rows of an array column (no nulls) as a matrix of 64-bit whole numbers with ``columns`` columns."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == columns).all():
        return flat.reshape(len(sizes), columns)
    out = np.zeros((len(sizes), columns), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
