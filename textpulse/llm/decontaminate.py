"""Benchmark decontamination: windows of item words in a broadcast hash set, looked up for every window of a text.

Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased. An item's windows are its ``window``
consecutive words, or all its words if it has fewer. The benchmark is cut into blocks of at most ``BLOCK_BYTES``, and the
texts pass through one lookup a block, so what is broadcast has a fixed size however many items there are. A lookup
compares rolling hashes first and then the words themselves.

Defined results: null or empty texts have no words and are clean; an item without text has no windows; an item without id
marks words but is not listed; items sharing an id count once; repeated documents are judged one by one; other columns are
kept, columns named like the results are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.llm.buffers import ALNUM, LOWER_VALUES, Prefix, with_text_columns, words

WINDOW = 10
BLOCK_BYTES = 16 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_spans", T.ArrayType(T.IntegerType()))]


def item_windows(items: list[tuple[str | None, str]], window: int = WINDOW) -> dict[int, dict[int, list]]:
    """``{length: {hash: [(words, item ids)]}}``."""
    out: dict[int, dict[int, dict[bytes, set]]] = {}
    for item, text in items:
        data = np.frombuffer(text.encode(), np.uint8)
        start, end, _ = words(data, np.array([0, len(data)]), ALNUM)
        size = min(window, len(start))
        if not size:
            continue
        raw = WORD.findall(text.encode().lower())
        hashes = Prefix(Prefix(LOWER_VALUES[data]).spans(start, end)).windows(size)
        for i, h in enumerate(hashes.tolist()):
            out.setdefault(size, {}).setdefault(h, {}).setdefault(b" ".join(raw[i:i + size]), set()).add(item)
    return {n: {h: [(w, sorted(x for x in ids if x is not None)) for w, ids in same.items()] for h, same in table.items()}
            for n, table in out.items()}


class Lookup:
    """Sorted hashes behind a bit table, for one window length."""

    def __init__(self, size: int, table: dict[int, list]):
        self.size, self.table = size, table
        self.hashes = np.array(sorted(table), np.uint64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.hashes >> np.uint64(44)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == hashes[maybe]]


def _finder(tables: dict[int, dict[int, list]]):
    lookups = [Lookup(n, t) for n, t in sorted(tables.items())]

    def compute(data: np.ndarray, bounds: np.ndarray):
        n = len(bounds) - 1
        start, end, row = words(data, bounds, ALNUM)
        hashes = Prefix(Prefix(LOWER_VALUES[data]).spans(start, end)) if len(start) else None
        steps = np.zeros(len(start) + 1, np.int32)
        items: list[set] = [set() for _ in range(n)]
        for look in lookups if len(start) else ():
            windows = hashes.windows(look.size)
            if not len(windows):
                continue
            whole = row[:len(windows)] == row[look.size - 1:]
            windows_at = look.hits(windows)
            for i in windows_at[whole[windows_at]].tolist():
                said = b" ".join(WORD.findall(data[start[i]:end[i + look.size - 1]].tobytes().lower()))
                for text, ids in look.table[int(windows[i])]:
                    if text == said:
                        items[row[i]].update(ids)
                        steps[i] += 1
                        steps[i + look.size] -= 1
        hit = np.cumsum(steps[:-1]) > 0
        of = np.searchsorted(row, np.arange(n + 1))
        spans: list[list[int]] = [[] for _ in range(n)]
        if hit.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))) | _new_row(row, hit))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if hit[lo]:
                    base = bounds[row[lo]]
                    spans[row[lo]] += [int(start[lo] - base), int(end[hi - 1] - base)]
        total = np.concatenate(([0], np.cumsum(hit)))
        return [np.diff(of), total[of[1:]] - total[of[:-1]], pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.int32()))]
    return compute


def _new_row(row: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Borders between texts, as a run of hits must not go on from one into the next."""
    out = np.zeros(len(row) + 1, bool)
    out[1:-1] = row[1:] != row[:-1]
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item: str = "item_id",
                   item_text: str = "text", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``hit_spans`` (byte starts and ends of the hit stretches)."""
    spark = docs.sparkSession
    named = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("item"),
                                                               F.col(item_text).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        part = named if blocks == 1 else named.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        tables = spark.sparkContext.broadcast(item_windows([tuple(r) for r in part.toLocalIterator()], window))
        found = with_text_columns(docs if out is None else out, FIELDS if out is None else [
            T.StructField(f"_{f.name}", f.dataType) for f in FIELDS], lambda t=tables: _finder(t.value), text)
        if out is not None:
            found = found.withColumns({
                "items": F.array_sort(F.array_union("items", "_items")),
                "hit_spans": F.concat("hit_spans", "_hit_spans")}).drop("_n_words", "_n_hit", "_items", "_hit_spans")
        out = found
    if blocks == 1:
        return out
    return with_merged_hits(out, text)


def with_merged_hits(found: DataFrame, text: str = "text") -> DataFrame:
    """Join stretches that several blocks of the benchmark have hit, and count their words once."""
    names = [f.name for f in found.schema.fields]

    def run(batches):
        for batch in batches:
            hits, merged = [], []
            for value, spans in zip(batch.column(text).to_pylist(), batch.column("hit_spans").to_pylist()):
                joined: list[int] = []
                for lo, hi in sorted(zip(spans[::2], spans[1::2])):
                    if joined and lo <= joined[-1]:
                        joined[-1] = max(joined[-1], hi)
                    else:
                        joined += [lo, hi]
                raw = (value or "").encode().lower()
                hits.append(sum(len(WORD.findall(raw[lo:hi])) for lo, hi in zip(joined[::2], joined[1::2])))
                merged.append(joined)
            new = {"n_hit": pa.array(hits, pa.int64()), "hit_spans": pa.array(merged, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)],
                                             batch.schema.names)

    return found.select(*names).mapInArrow(run, found.schema)


def items_digest(items: str = "items") -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def remove_hits(found: DataFrame, drop_share: float = 0.5, text: str = "text") -> DataFrame:
    """Cut the hit stretches out of the texts; a text of which ``drop_share`` or more is hit goes as a whole.

    Columns are those of ``found`` without the results of ``find_benchmark``; clean texts are returned byte for byte.
    """
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < drop_share * F.col("n_words")))
    raw, spans = F.encode(text, "UTF-8"), F.col("hit_spans")
    starts = F.filter(spans, lambda _, i: i % 2 == 1)  # where kept stretches begin: at the ends of hit ones
    begin = F.concat(F.array(F.lit(0)), starts)
    end = F.concat(F.filter(spans, lambda _, i: i % 2 == 0), F.array(F.octet_length(text)))
    cut = F.array_join(F.transform(F.arrays_zip(begin.alias("b"), end.alias("e")), lambda s: F.decode(
        F.substring(raw, s["b"] + 1, s["e"] - s["b"]), "UTF-8")), "")
    return kept.withColumn(text, F.when(F.col("n_hit") > 0, cut).otherwise(F.col(text))).drop(*(f.name for f in FIELDS))
