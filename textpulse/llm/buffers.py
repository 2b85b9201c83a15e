"""Arrow text columns as byte arrays: words, lines and polynomial hashes without one Python object per row.

A batch is cut into chunks of whole texts of about ``CHUNK_BYTES``; every array below lives for one chunk, so a task needs
memory for a chunk or for its longest text, whichever is larger. A null text has no bytes.

Hashes are polynomials over random 64-bit values of bytes (or of words), modulo 2**64 with an odd base: with the prefix
sums of a chunk, the hash of any stretch is one subtraction and one multiplication.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20
SMALL_CHUNK_BYTES = 1 << 18  # for operators whose arrays are many times the text
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES = _VALUES
LOWER_VALUES = _VALUES[LOWER]  # A-Z hash like a-z
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
VISIBLE = ~SPACE
ALNUM = np.ones(256, bool)  # bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM[0x00:0x30] = ALNUM[0x3A:0x41] = ALNUM[0x5B:0x61] = ALNUM[0x7B:0x80] = False
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** n`` modulo 2**64, kept for the next chunk."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, CHUNK_BYTES + CHUNK_BYTES // 4) + 1, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash (fixed values of the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Prefix sums of the polynomial hash of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n)[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(INVERSE, len(self.sums))[start])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all stretches of ``size`` values, by start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * powers(INVERSE, n)[:n])


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, bounds)``; ``bounds[i]:bounds[i + 1]`` are the bytes of the i-th row."""
    n = len(column)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes for which the table ``inside`` holds."""
    flag = inside[data]
    first, last = flag.copy(), flag.copy()
    first[1:] &= ~flag[:-1]
    last[:-1] &= ~flag[1:]
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    first[cut] = flag[cut]
    last[cut - 1] = flag[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(bounds, start, "right") - 1


def per_row(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of true marks in each row."""
    total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Flags of the positions 0..n-1 that lie in ``[start, start + size)`` for any start."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, starts + size, 1)
    return np.cumsum(steps[:-1]) > 0


def with_text_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable], text: str = "text",
                      beside: str | None = None, limit: int = CHUNK_BYTES) -> DataFrame:
    """Add columns computed from whole texts. ``make()`` runs once a task and returns ``f(data, bounds) -> arrays``,
    or ``f(data, bounds, values)`` with the values of the column ``beside``.

    A column of ``df`` that has the name of a new one is replaced.
    """
    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    types = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            parts: list[list[pa.Array]] = [[] for _ in fields]
            extra = batch.column(beside).to_pylist() if beside else None
            for lo, hi, data, bounds in text_chunks(batch.column(text), limit):
                for into, kind, values in zip(parts, types, compute(data, bounds, *([extra[lo:hi]] if beside else []))):
                    into.append(values if isinstance(values, pa.Array) else pa.array(values, kind))
            new = [pa.concat_arrays(p) if p else pa.array([], k) for p, k in zip(parts, types)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + new, [f.name for f in kept] + names)

    needed = df.select(*(f"`{f.name}`" for f in kept)) if text in {f.name for f in kept} else df
    return needed.mapInArrow(run, T.StructType(kept + fields))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


BLOCK = 1 << 13
_PART = "name string, block int, cells binary"


def summed_vectors(df: DataFrame, count: Callable, size: int, union: bool = False) -> DataFrame:
    """Sums of named integer vectors over all rows: ``(name, block, cells)`` with ``BLOCK`` 64-bit cells a row.

    With ``union`` the cells are sets of bits and united.

    ``count(batches)`` runs in each task and returns its own ``{name: vector of size}``. Tasks' vectors are added by
    (name, block) as a stream, so neither a task nor the driver ever holds more than the sums themselves.
    """
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, vector in count(batches).items():
            full = np.zeros(-(-size // BLOCK) * BLOCK, np.int64)
            full[:size] = vector
            blocks = full.reshape(-1, BLOCK)
            used = np.flatnonzero(blocks.any(axis=1))
            if len(used):
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()),
                    pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in used], pa.binary())], ["name", "block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for name, block, cells in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part = np.frombuffer(zlib.decompress(cells), np.int64)
                have = sums.get((name, block))
                sums[name, block] = part if have is None else have | part if union else have + part
        if sums:
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()),
                pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], ["name", "block", "cells"])

    return df.mapInArrow(tasks, _PART).repartition("name", "block").mapInArrow(add, _PART)


def collect_vectors(parts: DataFrame, size: int, most: int) -> dict[str, np.ndarray]:
    """The summed vectors in the driver. Their size is ``names * size * 8`` bytes; over ``most`` names is an error.

    One job for all partitions, whose compressed blocks come as Arrow batches.
    """
    out: dict[str, np.ndarray] = {}
    for batch in parts.toArrow().to_batches():
        for name, block, cells in zip(*batch.columns):
            vector = out.setdefault(name.as_py(), np.zeros(-(-size // BLOCK) * BLOCK, np.int64))
            vector[block.as_py() * BLOCK:(block.as_py() + 1) * BLOCK] = np.frombuffer(zlib.decompress(cells.as_buffer()), np.int64)
            if len(out) > most:
                raise ValueError(f"more than {most} names: the table of counts would not stay small")
    return {k: v[:size] for k, v in out.items()}
