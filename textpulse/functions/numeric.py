"""Null rules, tie-safe rounding and the studentised range."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits kept before ordering on a computed double, so that summation order cannot decide a tie.
TIE_DIGITS = 9


def zero_as_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def null_as_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def tie_safe(x: Column) -> Column:
    """Round before ranking; adding 0.0 turns a negative zero into zero."""
    return F.round(x, TIE_DIGITS) + F.lit(0.0)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)


def _erf(x: np.ndarray) -> np.ndarray:
    return np.array([math.erf(v) for v in x.ravel()]).reshape(x.shape)


def _span(lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    half = (hi - lo) / 2.0
    return half * _NODES + (hi + lo) / 2.0, half * _WEIGHTS


_Z, _WZ = _span(-8.5, 8.5)
_PHI = np.exp(-_Z * _Z / 2.0) / math.sqrt(2.0 * math.pi)
_CDF = 0.5 * (1.0 + _erf(_Z / math.sqrt(2.0)))


def _range_cdf(width: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= width), for an array of widths."""
    below = 0.5 * (1.0 + _erf((_Z[None, :] - width[:, None]) / math.sqrt(2.0)))
    gap = np.clip(_CDF[None, :] - below, 0.0, 1.0)
    return np.clip(k * (gap ** (k - 1) * (_PHI * _WZ)[None, :]).sum(axis=1), 0.0, 1.0)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """Upper tail of the studentised range: P(Q > q) for k means and df degrees of freedom."""
    if not (q > 0):
        return 1.0
    # Density of s = sqrt(chi2_df / df), integrated where it is not negligible.
    spread = 9.0 / math.sqrt(2.0 * df)
    s, ws = _span(max(1e-9, 1.0 - spread), 1.0 + spread + 3.0 / df)
    log_density = (
        math.log(2.0) + (df / 2.0) * math.log(df / 2.0) - math.lgamma(df / 2.0)
        + (df - 1.0) * np.log(s) - df * s * s / 2.0
    )
    density = np.exp(log_density)
    total = float((density * ws).sum())
    inside = float((_range_cdf(q * s, k) * density * ws).sum())
    return min(1.0, max(0.0, 1.0 - inside / total))


def studentized_range_critical(alpha: float, k: int, df: float) -> float:
    """The q whose upper tail is ``alpha``, by bisection."""
    lo, hi = 0.0, 8.0
    while studentized_range_sf(hi, k, df) > alpha:
        hi *= 2.0
    for _ in range(50):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if studentized_range_sf(mid, k, df) > alpha else (lo, mid)
    return (lo + hi) / 2.0


@F.pandas_udf(T.DoubleType())
def studentized_range_p(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    """Adjusted p-value per row of a (small) table of group pairs."""
    return pd.Series([
        None if pd.isna(a) or pd.isna(c) or c <= 0 else studentized_range_sf(float(a), int(b), float(c))
        for a, b, c in zip(q, k, df)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def studentized_range_q(alpha: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    """Critical value per row; equal (alpha, k, df) are solved once per batch."""
    solved: dict[tuple, float] = {}

    def one(a, b, c):
        if pd.isna(c) or c <= 0:
            return None
        key = (float(a), int(b), float(c))
        if key not in solved:
            solved[key] = studentized_range_critical(*key)
        return solved[key]

    return pd.Series([one(*row) for row in zip(alpha, k, df)], dtype="float64")
