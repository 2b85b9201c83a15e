"""Singular values and right singular vectors of tall sparse matrices, in passes over blocks of directions (L1).

The rows are documents and stay where they are; the columns are the terms of a vocabulary. A seeded Gaussian block is multiplied by
A^T A once a pass. What its image holds outside all earlier blocks, made orthonormal in the driver, is the next block: together they span
a Krylov space. After each pass the best directions of the space are known with their residuals, and passes go on until those of all
wanted directions are small beside their values (``ACCURACY``). A vocabulary of any size takes this way, whatever passes it needs. A space that has grown to its bound is shrunk to its better half and grows on from there (a thick restart), so less
memory means more passes and the same result.

The last pass reduces A, seen through the kept directions, to a triangular factor by a tree of QR factorisations: each task folds its rows
into one triangle, and triangles are stacked and folded again, ``FAN_IN`` at a time. The small SVD of the last triangle gives the values
to full precision, as no product A^T A enters it.

An update needs no old document: with A = U S V^T, the rows S V^T stand for all of A. The residual of the new documents
outside V is searched for its own range, and the triangle of the new documents through [V, J] is stacked below S (Brand's
update, with a block of documents for one).

The driver holds vocabulary x width of the space, in 8 bytes each and twice while it changes; ``MOST_BYTES`` bounds it. A vocabulary for
which not even two blocks fit is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCKS = 8  # of a space, if they fit; fewer take more passes
OVERSAMPLE = 56
ACCURACY = 1e-9  # residuals beside the smallest wanted value of A^T A
ROUNDING = 1e-12  # and beside the largest: what products in doubles resolve
WIDE = 0  # read by nothing since vocabularies of all sizes take the same way; tests set it
FAN_IN = 8
ROWS = 256  # folded or multiplied at once
SPARSE_ROWS = 2048  # whose images a task holds
TERMS = 64  # of a row of sums
MOST_BYTES = 1 << 30
SEED = 20240131


def sparse_rows(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, positions and values of a column of vectors as Spark passes it: sparse ones, or dense without positions."""
    at, values = column.field("indices"), column.field("values")
    if at.null_count == 0:
        bounds = np.concatenate(([0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        return bounds, at.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
    rows = [(np.arange(len(v)) if i is None else np.array(i, np.int64), np.array(v, float)) for i, v in zip(at.to_pylist(), values.to_pylist())]
    bounds = np.concatenate(([0], np.cumsum([len(v) for _, v in rows]))).astype(np.int64)
    return bounds, np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, used columns, dense rows over them) of some rows at a time, without the rows that hold nothing.

    The first array numbers the rows within their batch.
    """
    for batch in batches:
        bounds, at, values = sparse_rows(batch.column(0))
        full = np.flatnonzero(np.diff(bounds))
        for lo in range(0, len(full), rows):
            some = full[lo:lo + rows]
            span = slice(bounds[some[0]], bounds[some[-1] + 1])
            used, column = np.unique(at[span], return_inverse=True)
            dense = np.zeros((len(some), len(used)))
            dense[np.repeat(np.arange(len(some)), bounds[some + 1] - bounds[some]), column] = values[span]
            yield some, used, dense


def through(vectors: DataFrame, basis: np.ndarray, terms: int) -> np.ndarray:
    """A^T (A basis): one pass; tasks' sums are added by blocks of terms before they come to the driver."""
    shared = vectors.sparkSession.sparkContext.broadcast(basis)
    wide = basis.shape[1]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, touched = np.zeros((terms, wide)), np.zeros(terms, bool)
        for batch in batches:
            bounds, at, values = sparse_rows(batch.column(0))
            for lo in range(0, len(bounds) - 1, SPARSE_ROWS):
                part = bounds[lo:lo + SPARSE_ROWS + 1]
                touched[_add_product(total, shared.value, part - part[0], at[part[0]:part[-1]], values[part[0]:part[-1]])] = True
        blocks = np.unique(np.flatnonzero(touched) // TERMS)
        yield _batch(blocks, [total[b * TERMS:(b + 1) * TERMS] for b in blocks])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(cells.as_buffer())
                sums[b] = sums[b] + part if b in sums else part
        yield _batch(sums.keys(), sums.values())

    rows = vectors.mapInArrow(product, _BLOCK).repartition("block").mapInArrow(add, _BLOCK)
    out = np.zeros((terms, wide))
    for r in rows.toLocalIterator():
        part = np.frombuffer(r["cells"]).reshape(-1, wide)
        out[r["block"] * TERMS:r["block"] * TERMS + len(part)] = part
    return out


def _add_product(total: np.ndarray, basis: np.ndarray, bounds: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Adds A^T (A basis) of some sparse rows and returns the columns they use.

    A row is multiplied with the basis at its own columns, and a column with the images of its own rows: the work follows the
    values that are there, and not rows times all columns that any of the rows uses.
    """
    full = np.flatnonzero(np.diff(bounds))
    image = np.empty((len(full), basis.shape[1]))
    for i, r in enumerate(full):
        span = slice(bounds[r], bounds[r + 1])
        np.dot(values[span], basis.take(at[span], axis=0), out=image[i])
    order = np.argsort(at, kind="stable")
    row, values = np.repeat(np.arange(len(full)), np.diff(bounds)[full])[order], values[order]
    used, starts = np.unique(at[order], return_index=True)
    for column, lo, hi in zip(used, starts, [*starts[1:], len(at)]):
        total[column] += np.dot(values[lo:hi], image.take(row[lo:hi], axis=0))
    return used


_BLOCK = "block int, cells binary"


def _batch(numbers, arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.int32()), pa.array([a.tobytes() for a in arrays], pa.binary())], ["block", "cells"])


def _fold(triangle: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate([triangle, *rows]), mode="r") if rows else triangle


def triangle(vectors: DataFrame, basis: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of A basis, with at most as many rows as the basis is wide.

    A task keeps its triangle and as many rows as that has; the tree has a level for each factor ``FAN_IN`` of tasks.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(basis)
    wide = basis.shape[1]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, n = np.zeros((0, wide)), [], 0
        for _, used, dense in pieces(batches):
            rows.append(dense @ shared.value[used])
            n += len(dense)
            if n >= wide:
                held, rows, n = _fold(held, rows), [], 0
        held = _fold(held, rows)
        if len(held):
            yield _batch([TaskContext.get().partitionId() // FAN_IN], [held])

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(b, []).append(np.frombuffer(cells.as_buffer()).reshape(-1, wide))
        yield _batch([b // FAN_IN for b in found], [_fold(parts[0], parts[1:]) for parts in found.values()])

    tasks, level = vectors.rdd.getNumPartitions(), vectors.mapInArrow(reduce, _BLOCK)
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        level = level.repartition(tasks, "block").mapInArrow(stack, _BLOCK)
    out = np.zeros((0, wide))
    for r in level.toLocalIterator():
        out = _fold(out, [np.frombuffer(r["cells"]).reshape(-1, wide)])
    return out


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` holds outside ``against``; directions that are only rounding are left out."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # twice is enough
        block = block - against @ (against.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-10]
    u -= against @ (against.T @ u)
    return np.linalg.qr(u)[0][:, :len(block) - against.shape[1]]


def _affordable(terms: int, block: int, most: int) -> int:
    """Blocks of a space that ``MOST_BYTES`` can hold twice, ``most`` at most; fewer take more passes to the same accuracy."""
    fits = MOST_BYTES // (16 * terms * block)
    if fits < 1:
        raise ValueError(f"two blocks of {terms} terms and {block} columns take more than {MOST_BYTES} bytes; ask for fewer topics or prune the vocabulary")
    return min(most, fits)


def strongest(vectors: DataFrame, terms: int, k: int, passes: int | None = None, outside: np.ndarray | None = None, seed: int = SEED) -> np.ndarray:
    """An orthonormal basis that holds the ``k`` directions with the largest products, orthogonal to ``outside``, and ``OVERSAMPLE`` more.

    The products of the space's directions with each other are kept (``small``), and of the images only the newest: what A^T A makes of
    the earlier blocks lies inside the space. With ``passes`` the search ends after so many, exact or not.
    """
    outside = np.zeros((terms, 0)) if outside is None else outside
    n = min(k + OVERSAMPLE, terms - outside.shape[1])
    if n == terms - outside.shape[1]:
        return _orthonormal(np.eye(terms), outside) if n else np.zeros((terms, 0))
    blocks, read = max(2, _affordable(terms, n, BLOCKS)), 0
    newest = _orthonormal(np.random.default_rng(seed).normal(size=(terms, n)), outside)
    space, small = np.zeros((terms, 0)), np.zeros((0, 0))
    while True:
        image, read = through(vectors, newest, terms), read + 1
        image -= outside @ (outside.T @ image)
        space, old = np.concatenate((space, newest), axis=1), space.shape[1]
        cross = space.T @ image
        small = np.block([[small, cross[:old]], [cross[:old].T, (cross[old:] + cross[old:].T) / 2]])
        values, turned = np.linalg.eigh(small)
        values, turned = values[::-1], turned[:, ::-1]
        rest = image - space @ cross
        residuals = np.linalg.norm(rest @ turned[old:, :k], axis=0)
        if read == passes or residuals.max(initial=0) <= max(ACCURACY * values[min(k, len(values)) - 1], ROUNDING * values[0]):
            break
        newest = _orthonormal(image, np.concatenate((outside, space), axis=1))
        if not newest.shape[1]:
            break
        if space.shape[1] + newest.shape[1] > blocks * n:
            kept = blocks // 2 * n
            space, small = space @ turned[:, :kept], np.diag(values[:kept])
    # Images of the found directions hold nothing that A does not: terms with equal columns get equal entries.
    found, own = space @ turned[:, :n], values[:n] > 1e-6 * values[0]
    found[:, own] += rest @ turned[old:, :n][:, own] / values[:n][own]
    return _orthonormal(found, outside)


def _solved(small: np.ndarray, basis: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and vectors; each vector signed so that its largest entry is positive. Missing ones have the value 0."""
    _, sigma, turned = np.linalg.svd(small, full_matrices=True)
    sigma = np.concatenate((sigma, np.zeros(basis.shape[1])))[:k]
    loadings = basis @ turned[:k].T
    largest = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    return sigma, loadings * np.where(largest < 0, -1.0, 1.0)


def truncated(vectors: DataFrame, terms: int, k: int, passes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest singular values and their right vectors (``terms`` x ``k``), reading ``vectors`` until they are exact.

    ``vectors`` has one column of vectors with ``terms`` positions. A caller who must not read it more than ``passes`` times may say so.
    """
    k = min(k, terms)
    basis = strongest(vectors, terms, k, passes and passes - 1)
    return _solved(triangle(vectors, basis), basis, k)


def updated(sigma: np.ndarray, loadings: np.ndarray, vectors: DataFrame, k: int, passes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values and vectors of the old documents, known by ``sigma`` and ``loadings``, and of the new ones in ``vectors``."""
    terms = len(loadings)
    beyond = strongest(vectors, terms, k, passes and passes - 1, outside=loadings)
    basis = np.concatenate((loadings, beyond), axis=1)
    old = np.zeros((len(sigma), basis.shape[1]))
    old[np.arange(len(sigma)), np.arange(len(sigma))] = sigma
    return _solved(_fold(old, [triangle(vectors, basis)]), basis, min(k, terms))
