"""Vector codes: each of ``parts`` equal parts of a vector is replaced by the number of its nearest codebook entry.

The nearest entry is found in a geometric near-neighbour access tree (GNAT) over the entries of a part. A node has split points;
every other entry of the node belongs to the split point it is nearest to, and for each pair of a split point and a child the node
keeps the range of distances from the split point to what the child holds, the child's own split point included. A query
measures its distances to the split points; a child goes, as a whole, if some range lies strictly farther than the best distance so
far from the query's distance to that split point. Square roots and differences are rounded so that a child only goes when it cannot
hold the nearest entry or one as near; distances that decide are squares in whole numbers, ties go to the smaller number. A
batch of vectors goes through the tree together: each node sees the rows for which it is alive.

Codebooks start as the parts of the vectors with the smallest ids, and each round moves an entry to the floored mean of its
parts. A round is one map with sums by (part, entry), at most ``parts * entries`` rows a task, combined before they are shuffled.
Codebooks, ``parts * entries`` entries of a part of a vector, are all that the driver holds and broadcasts.

Defined results: a null vector, or one with a null or non-finite component, or one with a component of an absolute value
of ``MOST / scale`` or more, whose squares might not fit, is dropped. Shorter vectors are filled up with zeros, and so is the length to a
multiple of ``parts``. Repeated rows are coded each; of several rows under one id the smallest vector is a seed. A row without id is
coded and is no seed. With fewer vectors than entries a codebook has as many entries as there are ids; without any the result is
empty. Other columns are kept; those that have the name of a new one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.llm.tables import stored
from textpulse.llm.vectors import SCALE, matrix, usable, whole_numbers, width

PARTS = 16
ENTRIES = 64
ROUNDS = 2
DEGREE = 8
MOST = 1 << 26
ROUNDING = 1e-12  # relative; a square root and two sums err by less than 1e-15


class Node:
    """Split points (numbers of entries), their children, and ranges of distances ``(from split point, of child)``."""

    def __init__(self, points: np.ndarray, entries: np.ndarray, degree: int):
        self.splits = points[_spread(entries[points], degree)] if len(points) > degree else points
        self.children: list[Node | None] = [None] * len(self.splits)
        rest = np.setdiff1d(points, self.splits)
        if not len(rest):
            return
        near = _squares(entries[rest], entries[self.splits])
        owner = near.argmin(axis=1)
        held = [np.append(rest[owner == j], s) for j, s in enumerate(self.splits)]
        far = [np.sqrt(_squares(entries[self.splits], entries[h]).astype(float)) for h in held]
        self.least = np.array([f.min(axis=1) for f in far]).T
        self.most = np.array([f.max(axis=1) for f in far]).T
        for j in range(len(self.splits)):
            own = np.sort(rest[owner == j])
            if len(own):
                self.children[j] = Node(own, entries, degree)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` from all rows of ``b`` (few)."""
    out = np.zeros((len(a), len(b)), np.int64)
    for d in range(a.shape[1]):
        gap = a[:, d, None] - b[None, :, d]
        out += gap * gap
    return out


def _spread(entries: np.ndarray, n: int) -> np.ndarray:
    """``n`` positions far from each other: each next one is the farthest from those before."""
    chosen = [0]
    gap = _squares(entries, entries[:1])[:, 0]
    while len(chosen) < n:
        gap[chosen] = -1
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _squares(entries, entries[chosen[-1:]])[:, 0])
    return np.sort(np.array(chosen))


class Tree:
    """Nearest entries of many queries; ``measured`` counts the distances they took."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE):
        self.entries = entries
        self.root = Node(np.arange(len(entries)), entries, degree)
        self.measured = 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry and its squared distance."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        entry = np.full(len(queries), len(self.entries), np.int64)
        self._visit(self.root, queries, np.arange(len(queries)), best, entry)
        return entry, best

    def _visit(self, node: Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, entry: np.ndarray) -> None:
        squares = _squares(queries[rows], self.entries[node.splits])
        self.measured += squares.size
        first = squares.argmin(axis=1)  # split points ascend: the first of equal ones has the smallest number
        least, number = squares[np.arange(len(rows)), first], node.splits[first]
        better = (least < best[rows]) | ((least == best[rows]) & (number < entry[rows]))
        best[rows[better]], entry[rows[better]] = least[better], number[better]
        if not any(node.children):
            return
        far = np.sqrt(squares.astype(float))
        # Children of near split points come first: they tighten the best distance for the others.
        for j in np.argsort(far.mean(axis=0), kind="stable") if len(rows) else ():
            child = node.children[j]
            if child is None:
                continue
            reach = np.sqrt(best[rows].astype(float))[:, None]
            slack = ROUNDING * (far + reach + node.most[:, j])
            out = (far - reach > node.most[:, j] + slack) | (far + reach < node.least[:, j] - slack)
            alive = rows[~out.any(axis=1)]
            if len(alive):
                self._visit(child, queries, alive, best, entry)


def _cut(v: np.ndarray, parts: int) -> np.ndarray:
    return v.reshape(len(v), parts, v.shape[1] // parts)


def _unused(df: DataFrame, name: str) -> str:
    """A name for a working column that no column of ``df`` has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def seeds(rows: DataFrame, key: str, numbers: str, wide: int, parts: int, entries: int) -> np.ndarray:
    """Codebooks ``[part, entry, position]`` made of the vectors with the smallest ids."""
    ids = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(numbers).alias("v"))
    first = ids.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
    books = np.zeros((len(first), wide), np.int64)
    for i, r in enumerate(first):
        books[i, :len(r["v"])] = r["v"]
    return _cut(books, parts).transpose(1, 0, 2).copy()


def _assigned(column: pa.Array, trees: list[Tree], wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of the vectors, numbers of their nearest entries, and squared distances."""
    cut = _cut(matrix(column, wide), len(trees))
    found = [tree.nearest(np.ascontiguousarray(cut[:, p])) for p, tree in enumerate(trees)]
    return cut, np.stack([e for e, _ in found], axis=1), np.stack([s for _, s in found], axis=1)


def improved(numbers: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: floored means of the parts nearest to each entry; unused entries stay."""
    parts, entries, size = books.shape
    shared = numbers.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in shared.value]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            if len(batch):
                cut, entry, _ = _assigned(batch.column(0), trees, parts * size)
                for p in range(parts):
                    count[p] += np.bincount(entry[:, p], minlength=entries)
                    np.add.at(total[p], entry[:, p], cut[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]),
                                          pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = numbers.mapInArrow(run, "part int, entry int, n bigint, total array<bigint>")
    whole = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(size)))
    out = books.copy()
    for r in whole.collect():  # at most one row an entry
        out[r["part"], r["entry"]] = [r[f"t{d}"] // r["n"] for d in range(size)]
    return out


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id",
           vector: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The kept rows of ``vectors`` with ``_code`` (array of entry numbers) and ``_error`` (sum of squared distances), and the codebooks."""
    others = vectors.drop("_code", "_error")
    name = _unused(others, "_v")
    rows = others.where(usable(F.col(vector), MOST / scale)).withColumn(name, whole_numbers(F.col(vector), scale))
    wide = -(-width(rows, name) // parts) * parts or parts
    books = seeds(rows, key, name, wide, parts, entries)
    fields = T.StructType([*others.schema.fields, T.StructField("_code", T.ArrayType(T.IntegerType())), T.StructField("_error", T.LongType())])
    if not books.shape[1]:  # no id at all, so no entry
        return vectors.sparkSession.createDataFrame([], fields), books
    for _ in range(rounds):
        books = improved(rows.select(name), books)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in shared.value]
        for batch in batches:
            if len(batch):
                _, entry, square = _assigned(batch.column(batch.num_columns - 1), trees, wide)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, entry.size + 1, parts), pa.int32()), pa.array(entry.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes, pa.array(square.sum(axis=1))], fields.names)

    return rows.mapInArrow(run, fields), books


def hex_code(code: Column) -> Column:
    """Two lower-case hexadecimal digits an entry, in part order."""
    return F.array_join(F.transform(code, lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``_label_error``, the errors summed over equal labels, nulls together. ``coded`` is read twice: store it."""
    rows, name = coded.drop("_label_error"), _unused(coded, "_label")
    sums = rows.groupBy(F.col(label).alias(name)).agg(F.sum("_error").alias("_label_error"))
    return rows.join(sums, F.col(label).eqNullSafe(F.col(name))).drop(name)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, label: str = "label", **options) -> tuple[DataFrame, np.ndarray]:
    """``encode`` over a written table, with the errors of the labels."""
    table, books = encode(vectors, **options)
    return label_errors(stored(table, "codes"), label), books
