"""Similarity join of texts by the Jaccard coefficient of word n-grams, with adaptive multi-match prefixes.

A text's set is its distinct ``n``-word shingles as 64-bit hashes. Texts with equal sets form one class; classes are joined,
not texts. With similarity of at least ``t``, two sets of sizes a <= b share at least ``2t/(1+t) a`` and ``t b`` shingles, so
after ordering all shingles by one global order, rare ones first, they share ``k`` of the first ``a - ceil(2t/(1+t) a) + k``
and ``b - ceil(t b) + k``. The order decides how many pairs meet, so frequencies are learned in two steps.

A sketch of fixed size, in which every shingle of every text counts, tells very frequent shingles, which move to the end of the order.
The lists themselves are then measured exactly: the shingles of the longest prefix that a class may choose are counted by a shuffle, and
those that no other class has there drop out, as they link nothing. Each class chooses its own ``k`` from 1 to
``MAX_MATCH``: the lengths of its lists, and what is left to compare after asking for ``k`` shared tokens, give a cost,
and the cheapest is taken. A pair must share the smaller ``k`` of the two before it is compared.

Links are found in rounds. In the first, each list links its members to the list's first member (the one with the fewest shingles of
its own) and to their predecessors, and each member is compared with the one of each kind that it meets most often. Components
are formed; in the next, the components of a list other than its largest one send one member each to meet one
of the largest. This is linear in the lists. At last, in lists that still hold several components, members outside the largest
component meet all members of other components, in the shortest prefixes, where similar sets meet at least once, and the pairs'
chosen prefixes are counted against ``k``. No pair is formed there that cannot be similar: a
token that only one of two sets has, before one that both have, is in the other nowhere, and what follows is bounded by what is left
of the smaller. Pairs inside a component are never formed, so a
group of thousands of near copies costs a few rows a text. Lists that the sketch tells to be very long are split by a hash of the
member before they are sorted, and joined again by their first members.

Comparison is exact: a histogram of the hashes bounds what two sets can share, and for pairs within the bound the sets are
rebuilt from the whole texts. Components are computed by alternating the large-star and small-star steps on written tables,
with the trees of each task's own links formed in between.

Defined results: a null text, or one without words, has an empty set and links with nothing; a text with fewer than ``n`` words
has its whole sequence as its one shingle; rows with equal texts are one class. A row without id links with nothing and has a null
component. Several texts under one id are all compared, and belong together. Other columns are kept by ``deduplicate`` and ignored by the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.llm.buffers import (
    LOWER_VALUES, SMALL_CHUNK_BYTES, VISIBLE, Prefix, collect_vectors, mix, summed_vectors, text_chunks, with_text_columns, words)
from textpulse.llm.tables import bit_table, bounded_batches, may_be_in, stored

SKETCH = 1 << 18
MAX_MATCH = 16
VERIFY_COST = 20.0  # of one comparison, in postings
HISTOGRAM = 256
SPLIT = 1 << 16  # members of a posting list beyond which it is sorted in parts
ROUNDS = 1
FOREST = 1 << 18  # links that a task makes stars of at once
SET_ROWS = 256  # pairs with their whole sets, or texts, that go to Python at once
_MASK = (1 << 63) - 1  # digests are 63 bits


def stable(values: np.ndarray, most: int) -> np.ndarray:
    """Stable order of small whole numbers; a radix sort if they have 16 bits."""
    return np.argsort(values.astype(np.uint16 if most <= 1 << 16 else np.uint32), kind="stable")


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the rows, ordered by row and hash, and their rows."""
    start, end, row = words(data, bounds, VISIBLE)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = Prefix(Prefix(LOWER_VALUES[data]).spans(start, end))
    windows = sums.windows(n)
    at = np.flatnonzero(row[:len(windows)] == row[n - 1:]) if len(windows) else np.zeros(0, np.int64)
    count = np.bincount(row, minlength=len(bounds) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    first = np.searchsorted(row, short)
    # A short sequence is no window of another text: its length enters its hash.
    h = np.concatenate((windows[at], mix(sums.spans(first, first + count[short]) + count[short].astype(np.uint64))))
    of = np.concatenate((row[at], short))
    order = np.argsort(h)
    order = order[stable(of[order], len(bounds))]
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], of[new]


def _bins(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)  # the upper 18 bits


def sketch(docs: DataFrame, n: int, text: str = "text") -> np.ndarray:
    """Number of (text, shingle) pairs in each of ``SKETCH`` bins of shingle hashes."""
    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, data, bounds in text_chunks(batch.column(0), SMALL_CHUNK_BYTES):
                total += np.bincount(_bins(shingle_sets(data, bounds, n)[0]), minlength=SKETCH)
        return {"": total}

    return collect_vectors(summed_vectors(docs.select(text), count, SKETCH), SKETCH, 1).get("", np.zeros(SKETCH, np.int64))


def excess(counts: np.ndarray) -> np.ndarray:
    """Estimated frequency of the frequent shingle of a bin; 0 if the bin is not clearly above the middle."""
    middle = float(np.median(counts))
    return np.where(counts > middle + 6 * np.sqrt(middle) + 8, counts - middle, 0.0)


def least(share: Fraction, sizes: np.ndarray) -> np.ndarray:
    """``ceil(share * size)`` without rounding errors."""
    return -(-sizes * share.numerator // share.denominator)


def set_digests(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 63-bit sums over the hashes of each of ``n`` rows."""
    start = np.searchsorted(of, np.arange(n))
    full = np.searchsorted(of, np.arange(n), "right") > start
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(n, np.uint64)
        if len(h):
            sums[full] = np.add.reduceat(mix(h ^ np.uint64(salt)), start[full])
        out.append((sums & np.uint64(_MASK)).astype(np.int64))
    return out[0], out[1]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


SETS = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, tokens array<bigint>, heat array<bigint>, histogram binary"


def longest_prefixes(docs: DataFrame, n: int, share: Fraction, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Set size, digests, histogram, and the longest prefix that a text may choose, in order.

    ``heat`` is the estimated number of texts of a token's list if that is to be split, else 0.
    """
    frequency = docs.sparkSession.sparkContext.broadcast(excess(sketch(docs, n, text)).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = frequency.value
        level = np.where(freq > 0, np.ceil(np.log2(np.maximum(freq, 1))) + 1, 0).astype(np.int64)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, bounds in text_chunks(batch.column(1), SMALL_CHUNK_BYTES):
                rows = hi - lo
                h, of = shingle_sets(data, bounds, n)
                d1, d2 = set_digests(h, of, rows)
                order = stable(level[_bins(h)], 64)  # rows of h are in order of hash already
                order = order[stable(of[order], rows)]
                at = np.searchsorted(of, np.arange(rows + 1))
                size = np.diff(at)
                length = np.minimum(size - least(share, size) + MAX_MATCH, size)
                take = order[np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())]
                heat = freq[_bins(h[take])]
                cells = np.bincount(of * HISTOGRAM + (h & np.uint64(HISTOGRAM - 1)).astype(np.int64), minlength=rows * HISTOGRAM)
                cells = np.minimum(cells, 65535).astype("<u2").tobytes()  # clipped counts are no bound: see _may_be_similar
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, rows), pa.array(size), pa.array(d1), pa.array(d2), _lists(_signed(h[take]), length),
                    _lists(pa.array(np.where(heat > SPLIT, heat, 0).astype(np.int64)), length),
                    pa.array([cells[i:i + 2 * HISTOGRAM] for i in range(0, len(cells), 2 * HISTOGRAM)], pa.binary())],
                    [f.split()[0] for f in SETS.split(", ")])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text).mapInArrow(run, SETS)


def repeated(rows: DataFrame) -> DataFrame:
    """Of distinct rows ``(h, node)`` those whose ``h`` has several, with their number: ``(node, h, n)``.

    A stream over sorted rows that holds the rows of one ``h``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(h: np.ndarray, node: np.ndarray, counts: np.ndarray):
            number = np.repeat(counts, counts)
            keep = number > 1
            return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(h[keep]), pa.array(number[keep])], ["node", "h", "n"])

        for batch in batches:
            h, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if held and len(h) and h[0] == h[-1] == held[0][0][0]:
                held.append((h, node))
                continue
            h, node = (np.concatenate(x) for x in zip(*held, (h, node)))
            if len(h):
                starts = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1))
                last = starts[-1]
                yield out(h[:last], node[:last], np.diff(starts))
                held = [(h[last:], node[last:])]
        if held:
            h, node = (np.concatenate(x) for x in zip(*held))
            yield out(h, node, np.array([len(h)]))

    return rows.repartition("h").sortWithinPartitions("h").select("h", "node").mapInArrow(run, "node bigint, h bigint, n bigint")


CHOSEN = "id bigint, size bigint, k int, own int, short_own int, short int, rare bigint, tokens array<bigint>, frequent array<int>, room array<int>, rest array<int>"


def chosen_prefixes(classes: DataFrame, shared: DataFrame, share: Fraction) -> DataFrame:
    """``k`` and prefix of the classes whose prefix holds shared tokens, which ``shared`` lists as ``(node, h, n)``.

    The first ``own`` tokens are of the shorter prefix, by which a set meets sets that are not smaller; ``short_own`` and ``short`` are
    the lengths of both prefixes for ``k`` = 1, one token of which two similar sets share at least. ``frequent`` tells for each
    token into how many parts its posting list is split (0 and 1: not at all). ``rare`` tokens of the longest prefix are in no other;
    ``room`` is the size without those before a token: a set that shares the token has none of them, as its own prefix would hold it.
    ``rest`` is how many shingles come after the token.
    """
    listed = shared.groupBy("node").agg(F.collect_list(F.struct("h", "n")).alias("s"))  # no longer than a prefix
    hot = F.exists("heat", lambda x: x > 0)
    rows = classes.select("node", "n_shingles", "tokens", "heat").join(listed, "node", "left").where(F.col("s").isNotNull() | hot)
    both = 2 * share / (1 + share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, len(b), 256)):  # Python objects of a few rows at a time
            out = []
            for node, size, tokens, heat, s in zip(*(batch.column(i).to_pylist() for i in range(5))):
                known = {x["h"]: x["n"] for x in s or ()}
                lengths = np.array([x or known.get(t, 0) for t, x in zip(tokens, heat)], np.float64)
                whole = np.array([size])
                probe, index, most = size - int(least(share, whole)[0]), size - int(least(both, whole)[0]), max(1, int(least(share, whole)[0]))
                cost = np.concatenate(([0.0], np.cumsum(lengths)))
                m = np.arange(1, min(MAX_MATCH, most) + 1)
                k = int(np.argmin(cost[np.minimum(probe + m, size)] * (1 + VERIFY_COST / m))) + 1
                at = np.flatnonzero(lengths[:min(probe + k, size)])
                if len(at):
                    out.append((node, size, k, *(int(np.searchsorted(at, min(x, size))) for x in (index + k, index + 1, probe + 1)), int((lengths == 0).sum()),
                                [tokens[i] for i in at], [int(heat[i] // SPLIT) + 1 if heat[i] else 0 for i in at],
                                (size - np.cumsum(lengths == 0)[at]).tolist(), (size - at - 1).tolist()))
            columns = list(zip(*out)) or [[]] * 11
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], [f.split()[0] for f in CHOSEN.split(", ")])

    return rows.mapInArrow(run, CHOSEN)


def prefixes(docs: DataFrame, n: int, share: Fraction, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, k, tokens)``: the chosen ``k`` and whole prefix of every text; one that shares no token has ``k`` = 1."""
    texts = stored(longest_prefixes(docs, n, share, key, text).withColumn("node", F.monotonically_increasing_id()), "shingle-sets")
    tokens = texts.select("node", F.explode(F.arrays_zip("tokens", "heat")).alias("t")).where("t.heat = 0").select(F.col("t.tokens").alias("h"), "node")
    chosen = chosen_prefixes(texts, repeated(tokens), share).select(F.col("id").alias("node"), "k")
    needed = F.expr(f"(n_shingles * {share.numerator} + {share.denominator - 1}) div {share.denominator}")
    rows = texts.join(chosen, "node", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    length = F.least(F.col("n_shingles") - needed + F.col("k"), "n_shingles").cast("int")
    return rows.select("doc_id", "n_shingles", "k", F.slice("tokens", F.lit(1), length).alias("tokens"))


def _postings(chosen: DataFrame) -> DataFrame:
    """One row per prefix token of a class: (token, part, id, size, k, own, short, room, rest), in lists within a partition.

    A list begins with the member that has the fewest shingles of its own. Among near copies that is the text they were made from,
    which is closer to each of them than they are to each other; then ids decide.

    What a list has alone in its part, and does not share with other parts, is dropped by ``_neighbours``.
    """
    rows = chosen.select("id", F.col("size").cast("int").alias("size"), F.col("k").cast("short").alias("k"), "short_own", "short", "rare",
                         F.posexplode(F.arrays_zip("tokens", "frequent", "room", "rest")).alias("pos", "t"))
    parts = F.least(F.col("t.frequent"), F.lit(1 << 14))
    part = F.when(parts > 1, F.pmod(F.xxhash64("id"), parts)).otherwise(-1).cast("short")
    rows = rows.select(F.col("t.tokens").alias("token"), part.alias("part"), "id", "size", "k", (F.col("pos") < F.col("short_own")).alias("own"),
                       (F.col("pos") < F.col("short")).alias("short"),                        F.col("t.room").alias("room"), F.col("t.rest").alias("rest"), "rare")
    return rows.repartition("token", "part").sortWithinPartitions("token", "part", "rare", "id").drop("rare")


NEIGHBOURS = "token bigint, part short, id bigint, size int, k short, own boolean, short boolean, room int, rest int, head bigint, head_size int, previous bigint, previous_size int"


def _neighbours(postings: DataFrame) -> DataFrame:
    """Adds the first member of the list part and the member before, with their sizes; members alone in an unsplit list are left out.

    A stream over sorted rows that remembers one row, so a list may be of any length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, head, before = None, None, None  # the last row waits for its successor

        def emit(table: pa.RecordBatch, after: tuple | None):
            nonlocal head, before
            token, part, ids, size = (table.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            same = np.zeros(len(token), bool)
            same[1:] = (token[1:] == token[:-1]) & (part[1:] == part[:-1])
            same[0] = head is not None and head[0] == (token[0], part[0])
            follows = np.zeros(len(token), bool)
            follows[:-1] = same[1:]
            follows[-1] = after is not None and after == (token[-1], part[-1])
            starts = np.where(same, 0, np.arange(len(token)))
            first = np.maximum.accumulate(starts)
            heads, head_sizes = ids[first], size[first]
            if same[0]:
                run_end = int(np.argmin(same)) if not same.all() else len(same)
                heads[:run_end], head_sizes[:run_end] = head[1:]
            previous, previous_sizes = (np.concatenate(([x if same[0] else -1], y[:-1])) for x, y in zip(before or (-1, -1), (ids, size)))
            previous = np.where(same, previous, -1)
            head, before = ((token[-1], part[-1]), heads[-1], head_sizes[-1]), (ids[-1], size[-1])
            keep = pa.array(same | follows | (part >= 0))
            full = pa.RecordBatch.from_arrays(
                [*table.columns, pa.array(heads), pa.array(head_sizes), pa.array(previous), pa.array(previous_sizes.astype(np.int32))],
                [*table.schema.names, "head", "head_size", "previous", "previous_size"])
            return full.filter(keep)

        for batch in batches:
            if not len(batch):
                continue
            if rest is not None:
                yield emit(rest, (batch.column(0)[0].as_py(), batch.column(1)[0].as_py()))
            if len(batch) > 1:
                last = (batch.column(0)[len(batch) - 1].as_py(), batch.column(1)[len(batch) - 1].as_py())
                yield emit(batch.slice(0, len(batch) - 1), last)
            rest = batch.slice(len(batch) - 1)
        if rest is not None:
            yield emit(rest, None)

    return postings.mapInArrow(run, NEIGHBOURS)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that end inside the block pass ``SET_ROWS`` rows at a time to Python, as a row may hold two long texts' sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(SET_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _similar(sizes_a: str, sizes_b: str, share: Fraction):
    """Sizes that allow the similarity."""
    a, b = F.col(sizes_a), F.col(sizes_b)
    return (a * share.denominator >= b * share.numerator) & (b * share.denominator >= a * share.numerator)


def _may_be_similar(pairs: DataFrame, classes: DataFrame, share: Fraction) -> DataFrame:
    """Drop pairs whose histograms rule the similarity out.

    A histogram counts a set's shingles by 8 bits of their hash; the sum of the smaller counts bounds the intersection from above.
    """
    side = classes.select("node", F.col("n_shingles").cast("int"), "histogram")
    joined = pairs.join(side.toDF("a", "size_a", "cells_a"), "a").join(side.toDF("b", "size_b", "cells_b"), "b").select(
        "a", "b", "size_a", "size_b", "cells_a", "cells_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), "<u2").reshape(-1, HISTOGRAM).astype(np.int64) for i in (4, 5))
                sizes = sum(part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
                most = np.minimum(x, y).sum(axis=1)
                clipped = (x.max(axis=1) == 65535) | (y.max(axis=1) == 65535)
                keep.append(clipped | (share.denominator * most >= share.numerator * (sizes - most)))
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(np.concatenate(keep)))

    return joined.mapInArrow(run, "a bigint, b bigint")


def whole_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """``(node, hashes)`` of ``nodes``, rebuilt from the texts of their classes' smallest ids."""
    kept = classes.join(nodes, "node", "left_semi").select("node", "rep", "d1", "d2", "n_shingles")
    kept = stored(kept, "fetched")
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("text"))
    # Most other texts are dropped by a bit table of fixed size, in the task that makes the sets; the join drops the rest.
    table = docs.sparkSession.sparkContext.broadcast(bit_table(kept.select("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_be_in(batch, "rep", table.value)))
            for lo, hi, data, bounds in text_chunks(batch.column(1), SMALL_CHUNK_BYTES):
                h, of = shingle_sets(data, bounds, n)
                at = np.searchsorted(of, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), *map(pa.array, set_digests(h, of, hi - lo)),
                    pa.array([h[at[i]:at[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], ["rep", "n_shingles", "d1", "d2", "hashes"])

    found = rows.mapInArrow(run, "rep bigint, n_shingles bigint, d1 bigint, d2 bigint, hashes binary")
    keys = ["rep", "d1", "d2", "n_shingles"]
    return found.join(kept, keys).dropDuplicates(keys).select("node", "hashes")


def compare(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, share: Fraction, key: str, text: str) -> DataFrame:
    """Those ``(a, b)`` whose whole sets are similar enough; only texts of pairs that histograms leave are fetched."""
    pairs = stored(_may_be_similar(pairs, classes, share), "pairs")
    sets = stored(whole_sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), n, key, text), "sets")
    joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(share.denominator * shared >= share.numerator * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a bigint, b bigint")


def _forest(edges: DataFrame) -> DataFrame:
    """The links ``(a, b)`` of each task, ``FOREST`` at a time, as stars: every id of a task's tree links to the smallest one in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> pa.RecordBatch:
            ids, ends = np.unique(np.concatenate([np.stack(x) for x in held], axis=1), return_inverse=True)
            a, b = ends.reshape(2, -1)
            root = np.arange(len(ids))
            while len(a):
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root = root[root]
                a, b = root[a], root[b]
                a, b = a[a != b], b[a != b]
            other = root != np.arange(len(ids))
            return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[root[other]])], ["a", "b"])

        for batch in batches:
            for lo in range(0, len(batch), FOREST):
                part = batch.slice(lo, FOREST)
                held.append([part.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
                n += len(part)
                if n >= FOREST:
                    yield stars()
                    held, n = [], 0
        if held:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _are_stars(table: DataFrame) -> bool:
    """Whether every ``a`` has one ``b``, which links no further. Rows are distinct."""
    ends = F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up")))
    degrees = table.select(F.inline(ends)).groupBy("id").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return degrees.where("up > 1 OR up = 1 AND least = 0").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of all ids in ``edges(a, b)``: the smallest id that links reach.

    Tasks first turn their own links into stars. Then, until all links are stars, large star: every neighbour larger than a node
    links to the node's smallest neighbour. Small star: every smaller one does. The next tasks make stars of what they read first.
    """
    def star(table: DataFrame, large: bool) -> DataFrame:
        if large:
            both = table.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        else:
            both = table.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        smallest = both.groupBy("a").agg(F.min("b").alias("m"))
        smallest = smallest.select("a", F.least("a", "m").alias("m"))
        linked = both.join(smallest, "a")
        if large:
            return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        moved = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        return moved.unionByName(smallest.where("a <> m").select("a", F.col("m").alias("b"))).distinct()

    # Rows of two ids: an eighth of the tasks writes them, and reads more of them at once.
    tasks = max(8, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    table = stored(_forest(edges.where("a <> b")).distinct().coalesce(tasks), "edges")
    while not _are_stars(table):
        table = stored(star(star(_forest(table), True), False).coalesce(tasks), "edges")
    nodes = table.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(table.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()).coalesce(tasks)


def _best_partners(met: DataFrame, *kind: str) -> DataFrame:
    """Of rows ``(x, y, k)``, one a shared list, each x with the y it meets most often (of each kind), at least ``k`` times."""
    pairs = met.groupBy("x", "y", *kind).agg(F.count("*").alias("n"), F.max("k").alias("k"))
    best = pairs.groupBy("x", *kind).agg(F.max_by(F.struct("y", "n", "k"), F.struct("n", -F.col("y"))).alias("p"))
    return best.where("p.n >= p.k").select(F.greatest("x", "p.y").alias("a"), F.least("x", "p.y").alias("b")).distinct()


def _along_lists(lists: DataFrame, share: Fraction) -> DataFrame:
    """Pairs of the first round, of sizes that allow the similarity: members with first members and predecessors, and first members
    of the parts of split lists."""
    sides = F.array(*(F.struct(F.lit(i).alias("kind"), F.col(y).alias("y"), F.col(f"{y}_size").alias("size_y")) for i, y in enumerate(("head", "previous"))))
    near = lists.select(F.col("id").alias("x"), "size", "k", F.inline(sides)).where("y >= 0 AND x <> y").where(_similar("size", "size_y", share))
    split = lists.where("part >= 0")
    across = split.select("token", F.col("head").alias("x"), F.col("head_size").alias("size")).distinct().join(
        split.groupBy("token").agg(F.min(F.struct("head", "head_size")).alias("to")), "token")
    across = across.where(F.col("x") != F.col("to.head")).where(_similar("size", "to.head_size", share)).select(
        F.greatest("x", "to.head").alias("a"), F.least("x", "to.head").alias("b"))
    # A list counts for its head and a neighbour only, so these counts may fall short of k; what they miss is left to later steps.
    return _best_partners(near, "kind").unionByName(across).distinct()


def _across_components(rows: DataFrame, share: Fraction) -> DataFrame:
    """Pairs of a further round: for each list, one member of every component but the largest with one of the largest."""
    groups = rows.groupBy("token", "component").agg(F.count("*").alias("m"), F.min(F.struct("id", "k", "size")).alias("one"))
    main = groups.groupBy("token").agg(F.max_by(F.struct("component", "one"), F.struct("m", "component")).alias("main"))
    met = groups.join(main, "token").where(F.col("component") != F.col("main.component")).where(_similar("one.size", "main.one.size", share))
    return _best_partners(met.select(F.col("one.id").alias("x"), F.col("main.one.id").alias("y"), F.least("one.k", "main.one.k").alias("k")))


def _met_in_lists(rows: DataFrame, share: Fraction) -> DataFrame:
    """The exact rest: members outside a list's largest component with all members of other components.

    A similar pair meets in the shortest prefixes, so only these are joined: in the first shared token, from which on either set has as
    many as they must share. Two sets that share a token share, up to it, no more than
    either has there of tokens that others have, and after it no more than either has left; if that is too little the pair is not formed.
    """
    enough = lambda most: most * (share.numerator + share.denominator) >= (F.col("size_a") + F.col("size")) * share.numerator
    rows = rows.where("short")
    shares = rows.groupBy("token", "component").agg(F.count("*").alias("m"))
    mixed = shares.groupBy("token").agg(F.count("*").alias("groups"), F.max_by("component", F.struct("m", "component")).alias("main"))
    rows = rows.join(mixed.where("groups > 1").select("token", "main"), "token")
    few = rows.where("component <> main").select(F.col("token").alias("t"), *(F.col(c).alias(f"{c}_a") for c in ("id", "size", "room", "rest", "component")))
    met = few.join(rows, (F.col("t") == F.col("token")) & (F.col("component_a") != F.col("component")) & _similar("size_a", "size", share)
                   & enough(F.least(F.col("room_a") - F.col("rest_a"), F.col("room") - F.col("rest")) + F.least("rest_a", "rest"))
                   & enough(F.least("rest_a", "rest") + 1)
                   & ((F.col("component") == F.col("main")) | (F.col("id_a") > F.col("id"))))
    return met.select(F.greatest("id_a", "id").alias("a"), F.least("id_a", "id").alias("b")).distinct()


def _sharing_enough(pairs: DataFrame, prefixes: DataFrame, share: Fraction) -> DataFrame:
    """Pairs whose chosen prefixes share the smaller ``k`` of the two, and whose sets can still share enough after the last shared token."""
    side = prefixes.select("id", "size", "k", "own", "tokens", "rest")
    names = ("size", "k", "own", "tokens", "rest")
    joined = pairs.join(side.toDF("a", *(f"{c}_a" for c in names)), "a").join(side.toDF("b", *(f"{c}_b" for c in names)), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, len(b), 1024)):
            facts = {f"{c}_{x}": batch.column(f"{c}_{x}").to_pylist() for c in ("size", "k", "own") for x in "ab"}
            lists = {f"{c}_{x}": batch.column(f"{c}_{x}") for c in ("tokens", "rest") for x in "ab"}
            keep = []
            for i in range(len(batch)):
                small, large = ("a", "b") if facts["size_a"][i] <= facts["size_b"][i] else ("b", "a")
                own = facts[f"own_{small}"][i] if facts["size_a"][i] != facts["size_b"][i] else len(lists[f"tokens_{small}"][i])
                x, y = (lists[f"tokens_{s}"][i].values.to_numpy(zero_copy_only=False) for s in (small, large))
                _, at, to = np.intersect1d(x[:own], y, assume_unique=True, return_indices=True)
                k = min(facts["k_a"][i], facts["k_b"][i])
                if len(at) < k:
                    keep.append(False)
                    continue
                left = min(lists[f"rest_{small}"][i][int(at.max())].as_py(), lists[f"rest_{large}"][i][int(to.max())].as_py())
                total = facts["size_a"][i] + facts["size_b"][i]
                keep.append((len(at) + left) * (share.numerator + share.denominator) >= total * share.numerator)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a bigint, b bigint")


def _stars(label: DataFrame) -> DataFrame:
    """Components as links of their ids with the smallest one."""
    return label.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def _labelled(lists: DataFrame, label: DataFrame) -> DataFrame:
    rows = lists.select("token", "id", "size", "own", "short", "room", "rest", "k").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return stored(rows, "labelled")


def similar_groups(docs: DataFrame, n: int = 5, share: tuple[int, int] = (80, 100), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row; the component is the smallest id that links reach."""
    out = _grouped(docs, n, share, key, text)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def _grouped(docs: DataFrame, n: int, share: tuple[int, int], key: str, text: str) -> DataFrame:
    """``(doc_id, n_shingles, d1, d2, component)`` of every row; without a component the row is alone in its own."""
    share = Fraction(*share)
    bounded_batches(docs.sparkSession)
    sets = stored(longest_prefixes(docs, n, share, key, text), "shingle-sets")
    classes = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("members"), *(F.first(c).alias(c) for c in ("tokens", "heat", "histogram")))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "shingle-classes")
    tokens = classes.select("node", F.explode(F.arrays_zip("tokens", "heat")).alias("t")).where("t.heat = 0").select(F.col("t.tokens").alias("h"), "node")
    prefixes = stored(chosen_prefixes(classes, repeated(tokens), share), "prefixes")
    lists = stored(_neighbours(_postings(prefixes)), "postings")
    def linked(pairs: DataFrame) -> DataFrame:
        with _small_batches(docs.sparkSession):
            return stored(compare(pairs, classes, docs, n, share, key, text), "links")

    label = stored(components(linked(_along_lists(lists, share))), "labels")
    rows = _labelled(lists, label)
    for _ in range(ROUNDS):
        more = linked(_across_components(rows, share))
        if more.isEmpty():
            break
        label = stored(components(_stars(label).unionByName(more)), "labels")
        rows = _labelled(lists, label)
    links = _stars(label).unionByName(linked(_sharing_enough(_met_in_lists(rows, share), prefixes, share)))
    # Several texts of one id belong together.
    several = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.struct("d1", "d2", "n_shingles")).alias("a"), F.max(F.struct("d1", "d2", "n_shingles")).alias("b")).where("a <> b").select("doc_id")
    keyed = sets.select("doc_id", "d1", "d2", "n_shingles").join(several, "doc_id", "left_semi").join(
        classes.select("d1", "d2", "n_shingles", "node"), ["d1", "d2", "n_shingles"]).select("doc_id", "node").distinct()
    same = keyed.join(keyed.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")
    final = stored(components(links.unionByName(same)), "labels")
    # A component is named by the smallest id of its classes. Only classes of several texts or with links need a name.
    reach = classes.select("d1", "d2", "n_shingles", "rep", "members", F.col("node").alias("id")).join(final, "id", "left").where(
        "members > 1 OR component IS NOT NULL")
    names = reach.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("name"))
    named = reach.join(names, "component", "left").select(
        F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("n_shingles").alias("_n"), F.coalesce("name", "rep").alias("component"))
    out = sets.select("doc_id", "n_shingles", "d1", "d2").join(
        named, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n_shingles") == F.col("_n")), "left")
    return out.select("doc_id", "n_shingles", "d1", "d2", "component")


def deduplicate(docs: DataFrame, n: int = 5, share: tuple[int, int] = (80, 100), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of similar texts: one with the smallest id, and of several such rows the one with the smallest text.

    Rows with equal texts but without id are a group, which goes if a row with an id has that text. Texts without words are alike
    in nothing and stay, repeated or not.
    """
    groups = stored(_grouped(docs, n, share, key, text), "groups")
    gone = groups.where("component < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.join(gone, docs[key].cast("bigint") == gone["_gone"], "left_anti")
    several = groups.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(
        F.col("doc_id").alias("_several"))
    nameless = groups.where("n_shingles > 0 AND doc_id IS NULL")
    if several.isEmpty() and nameless.isEmpty():
        return rows
    return _single(docs, rows, several, groups, n, key, text)


def _single(docs: DataFrame, rows: DataFrame, several: DataFrame, groups: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """One row for each of the ids in ``several``, and for each text of rows without id; repeated rows are combined before a shuffle."""
    columns = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in columns))
    with_id = rows.where(F.col(key).isNotNull())
    once = with_id.join(several, with_id[key].cast("bigint") == several["_several"], "left_anti")
    packed = with_id.join(several, with_id[key].cast("bigint") == several["_several"], "left_semi").select(
        F.col(key).alias("_id"), F.col(text).alias("_text"), whole.alias("_row"))
    packed = _with_digests(packed, n)
    wordless = packed.where("_size = 0").select("_row.*")
    kept = packed.where("_size > 0").groupBy("_id").agg(F.min_by("_row", "_text").alias("_row")).select("_row.*")
    bare = _with_digests(rows.where(F.col(key).isNull()).select(F.col(key).alias("_id"), F.col(text).alias("_text"), whole.alias("_row")), n)
    known = groups.where("doc_id IS NOT NULL AND n_shingles > 0").select(
        F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("n_shingles").alias("_size")).distinct()
    alone = bare.where("_size > 0").join(known, ["_d1", "_d2", "_size"], "left_anti").groupBy("_d1", "_d2", "_size").agg(
        F.min_by("_row", "_text").alias("_row")).select("_row.*")
    return once.unionByName(wordless).unionByName(kept).unionByName(bare.where("_size = 0").select("_row.*")).unionByName(alone)


def _with_digests(packed: DataFrame, n: int) -> DataFrame:
    """Adds set size and digests of the column ``_text``."""
    fields = [T.StructField(c, T.LongType()) for c in ("_size", "_d1", "_d2")]

    def make():
        def compute(data: np.ndarray, bounds: np.ndarray):
            h, of = shingle_sets(data, bounds, n)
            return (np.bincount(of, minlength=len(bounds) - 1), *set_digests(h, of, len(bounds) - 1))
        return compute

    return with_text_columns(packed, fields, make, text="_text", limit=SMALL_CHUNK_BYTES)
