"""Hard negatives by a vertical scan with branch and bound on decomposed data (BOND).

Rows are stored by dimension: one Parquet column for each component, so a batch arrives as arrays of one dimension each. An
anchor reads dimensions in the order of the descending magnitude of its own components. After every step the smallest and
largest value of each unread dimension bound what the rest can still add to a row's inner product; rows whose bounds miss
the wanted range leave the anchor's bitmap of candidates. What is left at the end has its exact score, a whole number.

Two scans for a block of at most ``ANCHORS`` anchors. The first finds an anchor's positives, the best rows of its label; the
range is all that may still enter the best ones. The second finds its negatives, rows of other labels in a window below each
positive's score; the range is the hull of the windows, whose lower ends rise as windows fill. Anchors and windows are what
is broadcast. Tasks keep the best of what they have seen, so an anchor leaves a task with a few rows whatever the task reads,
and no two rows are ever paired by a join.

The first steps of all anchors of a tile are done at once as a product with the columns, whose entries outside an anchor's step
are zero; an anchor goes on alone, over its candidates only, when fewer than ``ALONE`` of the rows are left to it.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part, nor do those with a
component so large (``limit``) that an inner product of doubles might be inexact. Shorter vectors are filled up with zeros.
Several rows under one id are one row, that with the smallest label, then the smallest vector. Equal scores go by the smaller id. An
anchor without another row of its label has no positives and no rows; a positive without a negative in its window has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse.llm.tables import stored
from textpulse.llm.vectors import SCALE, usable, whole_numbers, width
from textpulse.session import shared_dir

ANCHORS = 4096  # of one pair of scans: with 1,024 dimensions their components take 32 MB
TILE = 64
ALONE = 0.25
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def limit(dimensions: int) -> int:
    """Components below it have inner products below 2**53, which doubles hold exactly."""
    return int((2.0 ** 53 / max(dimensions, 1)) ** 0.5)


def decomposed(vectors: DataFrame, key: str, label: str, vector: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """Written table ``(id, label, d0, d1, ...)`` of the rows that take part, and the number of dimensions."""
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector)))
    wide = width(rows, vector)
    rows = rows.where(usable(F.col(vector), limit(wide) / scale)).select(
        F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), whole_numbers(F.col(vector), scale).alias("v"))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    columns = [F.coalesce(F.get("r.v", F.lit(d)), F.lit(0)).cast("int").alias(f"d{d}") for d in range(wide)]
    return stored(one.select("id", "r.label", *columns), "decomposed"), wide


class Block:
    """Anchors of one pair of scans, and the step of each dimension in each anchor's own order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q
        wide = q.shape[1]
        order = np.argsort(-np.abs(q), axis=1, kind="stable")
        sizes = []
        while sum(sizes) < wide:  # half of what is left: early steps seldom exclude a row, late ones often do
            sizes.append(-(-(wide - sum(sizes)) // 2))
        self.steps = len(sizes)
        step = np.repeat(np.arange(self.steps), sizes)
        self.step_of = np.empty(q.shape, np.int64)
        np.put_along_axis(self.step_of, order, np.broadcast_to(step, q.shape), axis=1)


def _bounds(block: Block, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most that the dimensions after each step add, by anchor and step; ``lo`` and ``hi`` are by dimension."""
    a, b = block.q * lo, block.q * hi
    least, most = (np.zeros((len(block.ids), block.steps)) for _ in range(2))
    for s in range(block.steps):
        rest = block.step_of > s
        least[:, s] = np.where(rest, np.minimum(a, b), 0).sum(axis=1)
        most[:, s] = np.where(rest, np.maximum(a, b), 0).sum(axis=1)
    return least, most


def resolve(block: Block, columns: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, tile: slice
            ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(anchor, rows, exact scores)`` of the rows whose score may lie in ``low..high`` of an anchor of the tile.

    ``start`` is the tile's bitmap of candidates. Sums are exact: single precision is used where every sum stays below 2**24.
    """
    ahead, most = _bounds(block, columns.min(axis=1).astype(float), columns.max(axis=1).astype(float))
    largest = (np.abs(block.q[tile]) * np.abs(columns).max(axis=1)).sum(axis=1).max(initial=0)
    kind = np.float32 if largest < 1 << 24 else np.float64
    data, q = columns.astype(kind), block.q[tile].astype(kind)
    step_of, names = block.step_of[tile], np.arange(len(block.ids))[tile]
    sums, alive, open_ = np.zeros((len(q), data.shape[1]), kind), start, np.ones(len(q), bool)

    def finish(i: int, rows: np.ndarray, s: int) -> tuple[int, np.ndarray, np.ndarray]:
        total = sums[i, rows]
        for later in range(s + 1, block.steps):
            read = np.flatnonzero(step_of[i] == later)
            total = total + q[i, read] @ data[np.ix_(read, rows)]
            keep = (total + most[names[i], later] >= low[names[i]]) & (total + ahead[names[i], later] <= high[names[i]])
            rows, total = rows[keep], total[keep]
        return names[i], rows, total.astype(np.int64)

    for s in range(block.steps):
        go = np.flatnonzero(open_)
        if not len(go):
            return
        sums[go] += np.where(step_of[go] == s, q[go], 0) @ data
        at = names[go]
        alive[go] &= (sums[go] + most[at, s, None] >= low[at, None]) & (sums[go] + ahead[at, s, None] <= high[at, None])
        left = alive[go].sum(axis=1)
        for i, n in zip(go, left):
            if n < ALONE * data.shape[1] or s == block.steps - 1:
                open_[i] = False
                if n:
                    yield finish(i, np.flatnonzero(alive[i]), s)


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` highest scores, equal ones by the smaller id."""
    if len(scores) > n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.lexsort((ids, -scores))


FOUND = "anchor int, id bigint, score bigint"


def _scan(table: DataFrame, wide: int, block: Block, n: int, windows: list[np.ndarray] | None) -> DataFrame:
    """What a task keeps of its rows: the best ``n`` of an anchor's label, or the best ``n`` of other labels in each window.

    ``windows[a]`` holds lowest and highest scores by window of anchor ``a``.
    """
    shared = table.sparkSession.sparkContext.broadcast((block, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows = shared.value
        count = len(block.ids)
        if windows is None:
            ranges = [np.array([[-np.inf, np.inf]])] * count
        else:
            ranges = [w.astype(float) for w in windows]
        low = np.array([r[:, 0].min() if len(r) else np.inf for r in ranges])
        high = np.array([r[:, 1].max() if len(r) else -np.inf for r in ranges])
        have = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(r) for r in ranges]
        for batch in batches:
            if not len(batch):
                continue
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
            columns = np.stack([batch.column(f"d{d}").to_numpy(zero_copy_only=False) for d in range(wide)]) if wide else np.zeros((1, len(ids)), np.int32)
            for lo in range(0, count, TILE):
                tile = slice(lo, min(lo + TILE, count))
                same = block.labels[tile, None] == labels[None, :]
                start = (same if windows is None else ~same) & (block.ids[tile, None] != ids[None, :])
                for a, rows, scores in resolve(block, columns, start, low, high, tile):
                    for w, (least, most) in enumerate(ranges[a]):
                        inside = (scores >= least) & (scores <= most)
                        if inside.any():
                            s, i = (np.concatenate(x) for x in zip(have[a][w], (scores[inside], ids[rows[inside]])))
                            best = _best(s, i, n)
                            have[a][w] = (s[best], i[best])
                    # A full window asks for its last score at least, one that is not full for all of its range.
                    low[a] = min((h[0][-1] if len(h[0]) == n else r[0] for h, r in zip(have[a], ranges[a])), default=np.inf)
        for a, sets in enumerate(have):
            if any(len(s) for s, _ in sets):
                pairs = np.unique(np.concatenate([np.stack((i, s), axis=1) for s, i in sets]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), a, np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                                                 ["anchor", "id", "score"])

    return table.mapInArrow(run, FOUND)


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _mined(table: DataFrame, wide: int, block: Block, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    spark = table.sparkSession
    best = _first(_scan(table, wide, block, positives, None), ["anchor"], positives).collect()  # at most ANCHORS * positives rows
    windows: list[list] = [[] for _ in block.ids]
    rows = []
    for r in best:
        # lo * positive <= 100 * negative <= hi * positive, in whole numbers
        least, most = -(-window[0] * r["score"] // 100), window[1] * r["score"] // 100
        windows[r["anchor"]].append((least, most))
        rows.append((r["anchor"], int(block.ids[r["anchor"]]), r["id"], r["score"], least, most))
    found = _scan(table, wide, block, negatives, [np.array(w, np.int64).reshape(-1, 2) for w in windows])
    wanted = spark.createDataFrame(rows, "anchor int, anchor_id bigint, positive_id bigint, positive_score bigint, least bigint, most bigint")
    met = found.join(F.broadcast(wanted), "anchor").where("score BETWEEN least AND most")
    return _first(met, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
         key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """Negatives of every (anchor, positive), best first; ``anchors`` is a condition on ``id``.

    ``window`` gives the least and the most that a negative's score may be, in hundredths of the positive's.
    """
    spark = vectors.sparkSession
    table, wide = decomposed(vectors, key, label, vector)
    path = shared_dir(spark, "llm-negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    rows = iter(table.where(anchors).toLocalIterator())
    while some := list(islice(rows, ANCHORS)):
        q = np.array([r[2:] for r in some], np.float64).reshape(len(some), wide) if wide else np.zeros((len(some), 1))
        block = Block(np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.int64), q)
        _mined(table, wide, block, positives, negatives, window).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)
