"""Removal of byte strings that occur more than once, by hash-compared suffix sorting around content-chosen anchors.

A string of ``SIZE`` bytes is repeated if it starts at two places. Sorting every suffix of the corpus would move hundreds of
times its size, so positions are first reduced to anchors: of the ``ANCHOR``-byte windows inside a ``SIZE``-byte string the one
with the smallest hash (the leftmost of equals) is its anchor. Equal strings have equal anchors at equal offsets, and neighbours mostly
share theirs, so some 1.3 % of positions are anchors. Each stands for a run of starts and has a context: all bytes those
strings can reach.

1. Anchors that occur once are done. Anchors whose whole context occurs again are done too: all their starts are repeated.
   Tasks settle equal contexts of their own batch at once and pass on one of them, so thousands of copies are few rows.
2. What is left lies at the edges of repeated stretches. These contexts are sorted twice, by the bytes to the right of the
   anchor and by the bytes to its left, read backwards: prefix polynomial hashes and a binary search find common
   extensions, so a comparison in the mergesort takes logarithmic time. Two strings that start ``a`` bytes before their
   anchors are equal exactly if they lie in one block of the first order with common extensions of at least ``SIZE - a`` and in
   one block of the second with at least ``a``. Extensions of neighbours are verified byte by byte, and a batch in which
   hashes collide is sorted by its bytes instead.
3. Starts become covered ranges per text, which are cut out.

Anchors at which more than ``LARGE`` different contexts meet are not sorted in one task: each of their strings is hashed and
counted by a combined aggregate, which is exact too.

Defined results: null and empty texts have no bytes; texts shorter than ``SIZE`` bytes lose nothing; repeated rows are
repeats of each other and lose all that is covered; other columns are kept by ``without_repeats``, except those named
like its results, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textpulse.llm.buffers import BASE, BYTE_VALUES, Prefix, mix, powers, text_chunks
from textpulse.llm.tables import bit_table, in_bit_table, stored

SIZE, ANCHOR = 200, 50
REACH = SIZE - ANCHOR  # an anchor lies at most this far behind the start of its string
LARGE = 50_000
BATCH_ROWS = 20_000
_PLACE = (1 << 31) - 1
_VALUES = np.concatenate(([np.uint64(0)], BYTE_VALUES))  # 0 stands for the end of a text, b + 1 for the byte b

ANCHORS = "settled boolean, doc bigint, body bigint, at int, lo int, hi int, anchor bigint, context bigint, n int"
MARKS = "doc bigint, body bigint, lo int, hi int"


def runs(data: np.ndarray, bounds: np.ndarray):
    """Rows, anchor offsets, first and last starts (all relative to the row), anchor and context hashes."""
    n = len(data)
    if n < SIZE:
        return None
    sums = Prefix(BYTE_VALUES[data])
    grams = sums.windows(ANCHOR)
    width = REACH + 1
    value = (grams & ~np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    blocks = np.full(-(-len(value) // width) * width, ~np.uint64(0))
    blocks[:len(value)] = value
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - SIZE + 1
    place = (np.minimum(behind[:starts], ahead[REACH:REACH + starts]) & np.uint64(_PLACE)).astype(np.int64)
    fits = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(bounds) >= SIZE)
    np.add.at(fits, bounds[long], 1)
    np.subtract.at(fits, bounds[long + 1] - SIZE + 1, 1)
    at = np.flatnonzero(np.cumsum(fits[:starts]) > 0)
    if not len(at):
        return None
    place = place[at]
    edge = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(at)]))
    lo, hi, place = at[edge[:-1]], at[edge[1:] - 1], place[edge[:-1]]
    row = np.searchsorted(bounds, lo, "right") - 1
    left, right = np.maximum(bounds[row], place - REACH), np.minimum(bounds[row + 1], place + SIZE)
    context = mix(sums.spans(left, right) + (place - left).astype(np.uint64))
    base = bounds[row]
    return row, place - base, lo - base, hi - base, grams[place], context


def anchors(docs: DataFrame) -> DataFrame:
    """Anchors of ``docs`` (doc, body, text). ``settled`` rows are starts that a batch found repeated by itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for lo, _, data, bounds in text_chunks(batch.column(2)):
                if (found := runs(data, bounds)) is not None:
                    parts.append((found[0] + lo, *found[1:]))
            if not parts:
                continue
            row, at, first, last, anchor, context = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(mix(anchor + mix(context)))
            x, y = anchor[order], context[order]
            new = np.ones(len(order), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(order)))
            many = np.repeat(size > 1, size)
            rows = np.concatenate((order[new], order[many]))
            settled = np.arange(len(rows)) >= new.sum()
            seen = np.concatenate((np.minimum(size, 2), np.zeros(many.sum(), np.int64)))
            take = pa.array(row[rows])
            yield pa.RecordBatch.from_arrays([
                pa.array(settled), batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c[rows].astype(np.int32)) for c in (at, first, last)),
                pa.array(anchor[rows].view(np.int64)), pa.array(context[rows].view(np.int64)), pa.array(seen.astype(np.int32))],
                [f.split()[0] for f in ANCHORS.split(", ")])

    return docs.select("doc", "body", "text").mapInArrow(run, ANCHORS)


class Order:
    """Sorted order of the rows of a byte matrix (0 for the end, byte + 1 otherwise) and common extensions of neighbours."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        n, width = codes.shape
        self.sums = np.zeros((n, width + 1), np.uint64)
        np.cumsum(_VALUES[codes] * powers(BASE, width)[:width], axis=1, out=self.sums[:, 1:])
        self.order = self._sorted()
        self.common = self._verified()

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows ``x`` and ``y``: binary search for the longest equal prefix hash."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.codes.shape[1])
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.sums[x, middle] == self.sums[y, middle]
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether rows ``x`` sort before rows ``y``, or at the same place if ``ties``."""
        e = self.extension(x, y)
        end = e == self.codes.shape[1]
        e = np.minimum(e, self.codes.shape[1] - 1)
        return np.where(end, ties, self.codes[x, e] < self.codes[y, e])

    def _sorted(self) -> np.ndarray:
        """Mergesort from below: in each round every element finds its rank in the neighbouring run by binary search."""
        n, width = len(self.codes), 1
        order = np.arange(n)
        while width < n:
            at = np.arange(n)
            run = at // width
            other = (run ^ 1) * width  # first place of the neighbouring run
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            start, right = low.copy(), (run & 1) == 1
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                # An element of the right run comes after its equals in the left one.
                before = np.where(right[open_], ~self.less(order[at[open_]], order[middle], False),
                                  self.less(order[middle], order[at[open_]], False))
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            target = np.minimum(run * width, other) + (at - run * width) + (low - start)
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, 2 * width
        return order

    def _verified(self) -> np.ndarray:
        x, y = self.order[:-1], self.order[1:]
        by_hash = self.extension(x, y)
        true, sorted_ = self._by_bytes()
        if len(x) and not ((by_hash == true).all() and sorted_):
            self.order = np.lexsort(self.codes.T[::-1])
            true, _ = self._by_bytes()
        return true

    def _by_bytes(self) -> tuple[np.ndarray, bool]:
        """True common extensions of neighbours, and whether the order holds."""
        n, width = self.codes.shape
        true, good = np.empty(max(0, n - 1), np.int64), True
        for lo in range(0, n - 1, 4096):
            a, b = self.codes[self.order[lo:min(lo + 4096, n - 1)]], self.codes[self.order[lo + 1:min(lo + 4097, n)]]
            differs = a != b
            first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
            true[lo:lo + len(a)] = first
            at = np.minimum(first, width - 1)[:, None]
            good &= bool((np.take_along_axis(a, at, 1) <= np.take_along_axis(b, at, 1)).all())
        return true, good

    def blocks(self, least: int) -> np.ndarray:
        """Block of each row: rows with common prefixes of ``least`` bytes share one."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.concatenate(([0], np.cumsum(self.common < least)))
        return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Bytes of a binary column as codes, padded with the end code."""
    n = len(column)
    out = np.zeros((n, width), np.int16)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
    out[np.repeat(np.arange(n), size), place] = data.astype(np.int16) + 1
    return out


CONTEXTS = "anchor bigint, doc bigint, body bigint, at int, lo int, hi int, open boolean, left binary, right binary"


def contexts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Bytes around the anchors of ``needed``: ``left`` is read backwards from the anchor."""
    lists = needed.groupBy("doc", "body").agg(F.collect_list(F.struct("anchor", "at", "lo", "hi", "open")).alias("list"))
    lists = lists.withColumnsRenamed({"doc": "_doc", "body": "_body"})
    rows = docs.join(lists, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body"))).select("doc", "body", "text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, at = lists.flatten(), np.asarray(lists.offsets)
            anchor, place, lo, hi, open_ = (flat.field(i) for i in range(5))
            row = np.repeat(np.arange(len(batch)), np.diff(at))
            spots = place.to_numpy(zero_copy_only=False)
            left, right = [], []
            texts = [v.as_py().encode() for v in batch.column(2)]
            for r, p in zip(row.tolist(), spots.tolist()):
                left.append(texts[r][max(0, p - REACH):p][::-1])
                right.append(texts[r][p:p + SIZE])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([anchor, batch.column(0).take(take), batch.column(1).take(take), place, lo, hi, open_,
                                              pa.array(left, pa.binary()), pa.array(right, pa.binary())], [f.split()[0] for f in CONTEXTS.split(", ")])

    return rows.mapInArrow(run, CONTEXTS)


def _repeated(left: np.ndarray, right: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """``[row, a]``: whether the string that starts ``a`` bytes before the anchor of the row occurs in another row."""
    by_right, by_left = Order(right), Order(left)
    out = np.zeros((len(at), REACH + 1), bool)
    for a in range(REACH + 1):
        rows = np.flatnonzero((at - a >= lo) & (at - a <= hi))
        if len(rows) > 1:
            key = by_right.blocks(SIZE - a)[rows] * len(at) + by_left.blocks(a)[rows]
            _, group, size = np.unique(key, return_inverse=True, return_counts=True)
            out[rows, a] = size[group] > 1
    return out


def _ranges(repeated: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated starts: their rows, first and last starts."""
    flags = np.zeros((len(at), REACH + 3), np.int8)
    flags[:, 1:-1] = repeated[:, ::-1]  # ascending starts
    step = np.diff(flags, axis=1)
    row, first = np.nonzero(step == 1)
    _, after = np.nonzero(step == -1)
    return row, at[row] - REACH + first, at[row] - REACH + after - 1


def sorted_marks(found: DataFrame) -> DataFrame:
    """Repeated starts among ``contexts``; rows of one anchor are in one partition."""
    names = [f.split()[0] for f in CONTEXTS.split(", ")]

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        column = {c: table.column(c).combine_chunks() if table.num_rows else None for c in names}
        at, lo, hi = (column[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "lo", "hi"))
        repeated = _repeated(matrix(column["left"], REACH), matrix(column["right"], SIZE), at, lo, hi)
        repeated &= column["open"].to_numpy(zero_copy_only=False)[:, None]
        row, first, last = _ranges(repeated, at)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([column["doc"].take(take), column["body"].take(take), pa.array(first.astype(np.int32)),
                                           pa.array(last.astype(np.int32))], ["doc", "body", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            # Cut where the anchor changes, so that an anchor is never in two sorts.
            anchor = batch.column(0).to_numpy(zero_copy_only=False)
            before = held[-1].column(0)[-1].as_py() if held else None
            cuts = np.flatnonzero(np.diff(anchor)) + 1
            if len(anchor) and before is not None and before != anchor[0]:
                cuts = np.concatenate(([0], cuts))
            done = 0
            for cut in cuts.tolist():
                if rows + cut - done >= BATCH_ROWS:
                    held.append(batch.slice(done, cut - done))
                    yield solve(pa.Table.from_batches(held))
                    held, rows, done = [], 0, cut
            if done < len(batch):
                held.append(batch.slice(done))
                rows += len(batch) - done
        if rows:
            yield solve(pa.Table.from_batches(held))

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, MARKS)


def counted_marks(found: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: strings are hashed one by one and counted."""
    names = "doc bigint, body bigint, open boolean, anchor bigint, start int, h1 bigint, h2 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, len(batch), 512):
                part = batch.slice(cut, 512)
                column = {c: part.column(i) for i, c in enumerate(part.schema.names)}
                at, lo, hi = (column[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "lo", "hi"))
                left, right = matrix(column["left"], REACH), matrix(column["right"], SIZE)
                whole = np.concatenate((left[:, ::-1], right), axis=1)  # the anchor is at REACH
                a = np.arange(REACH + 1)
                row, a = np.nonzero((at[:, None] - a >= lo[:, None]) & (at[:, None] - a <= hi[:, None]))
                hashes = []
                for salt in (np.uint64(1), np.uint64(0x9E3779B97F4A7C15)):
                    sums = Prefix(mix(_VALUES[whole.ravel()] * salt))
                    start = row * whole.shape[1] + REACH - a
                    hashes.append(pa.array(sums.spans(start, start + SIZE).view(np.int64)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(column[c].take(take) for c in ("doc", "body", "open", "anchor")),
                                                  pa.array((at[row] - a).astype(np.int32)), *hashes], [f.split()[0] for f in names.split(", ")])

    strings = found.mapInArrow(run, names)
    again = strings.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "h1", "h2")
    hit = strings.where("open").join(again, ["anchor", "h1", "h2"], "left_semi")
    return hit.select("doc", "body", F.col("start").alias("lo"), F.col("start").alias("hi"))


FIELDS = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<int>"


def repeated_starts(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """``(doc, body, lo, hi)``: ranges of starts of repeated strings in ``docs`` (doc, body, text)."""
    found = stored(anchors(docs), "anchors")
    same = Window.partitionBy("anchor", "context")
    meet = Window.partitionBy("anchor")
    rows = found.where("NOT settled").repartition("anchor")
    rows = rows.withColumn("equal", F.sum("n").over(same)).withColumn("chosen", F.row_number().over(
        same.orderBy("doc", "body", "at")) == 1)
    rows = rows.withColumn("all", F.sum("n").over(meet)).withColumn("alone", F.count_if(F.col("equal") == 1).over(meet))
    rows = stored(rows.where("all > 1").withColumn("open", F.col("equal") == 1).withColumn("contexts", F.count_if("chosen").over(meet)).select(
        "doc", "body", "at", "lo", "hi", "anchor", "open", "contexts", (F.col("chosen") & (F.col("alone") > 0)).alias("sent")), "repeats")
    settled = found.where("settled").select("doc", "body", "lo", "hi").unionByName(
        rows.where("NOT open").select("doc", "body", "lo", "hi"))
    sent = rows.where("sent")
    near = stored(contexts(in_bit_table(docs, "body", bit_table(sent.select("body"))), sent.select(
        "doc", "body", "at", "lo", "hi", "anchor", "open")), "contexts")
    crowded = sent.where(F.col("contexts") > large).select("anchor").distinct()
    marks = sorted_marks(near.join(crowded, "anchor", "left_anti"))
    if not crowded.isEmpty():
        marks = marks.unionByName(counted_marks(near.join(crowded, "anchor", "left_semi")))
    return settled.unionByName(marks)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", large: int = LARGE) -> DataFrame:
    """Adds ``n_bytes, n_removed, n_spans, kept_sha256`` and ``removed`` (starts and ends of the byte ranges that go)."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    others = [c for c in docs.columns if c not in names]
    body = F.coalesce(F.col(text), F.lit(""))
    full = docs.select(*others, F.xxhash64(body).alias("_body_hash"), F.col(key).cast("bigint").alias("_doc_key"))
    slim = docs.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(body).alias("body"), body.alias("text"))
    marks = stored(repeated_starts(slim, large), "marks")
    table = bit_table(marks.select("body"))
    clean = in_bit_table(full, "_body_hash", table, inside=False).select(
        *others, F.octet_length(body).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"), F.array().cast("array<int>").alias("removed"))
    lists = marks.groupBy(F.col("doc").alias("_d"), F.col("body").alias("_b")).agg(F.collect_list(F.struct("lo", "hi")).alias("_marks"))
    marked = in_bit_table(full, "_body_hash", table).join(
        lists, F.col("_doc_key").eqNullSafe(F.col("_d")) & (F.col("_body_hash") == F.col("_b")), "left").select(*others, "_marks")
    schema = docs.select(*others).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for value, ranges in zip(batch.column(text), batch.column("_marks")):
                raw = (value.as_py() or "").encode()
                cut: list[int] = []
                for r in sorted((m["lo"], m["hi"] + SIZE) for m in ranges.as_py() or ()):
                    if cut and r[0] <= cut[-1]:
                        cut[-1] = max(cut[-1], r[1])
                    else:
                        cut += r
                kept = hashlib.sha256()
                for lo, hi in zip([0, *cut[1::2]], [*cut[::2], len(raw)]):
                    kept.update(raw[lo:hi])
                row = (len(raw), sum(cut[1::2]) - sum(cut[::2]), len(cut) // 2, kept.hexdigest(), cut)
                for into, x in zip(out, row):
                    into.append(x)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(o, k) for o, k in zip(out, kinds)], others + names)

    cut = marked.mapInArrow(run, StructType(schema.fields + clean.select(*names).schema.fields))
    return clean.unionByName(cut)
