"""Counts of the words and pairs of neighbours of whole documents, by sorting word numbers and not words.

A task numbers the distinct words of some documents, and counts are those of equal whole numbers. Words become strings again once
a distinct term.

Terms that are frequent in the whole corpus are found without a shuffle of the others: tasks count hashes of terms in a table of
fixed size, whose sums bound the document frequency of each term from above. A second reading keeps the terms that can reach the
frequency asked for, and their exact counts decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TOKENS = 1 << 20  # counted at once, or those of the longest document
BUCKETS = 1 << 22
BLOCK = 1 << 16  # buckets of a row of sums
_PAIR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of some documents as numbers: ``row`` and ``code`` of each token, ``words`` by code."""

    def __init__(self, rows: int, tokens: pa.Array):
        known = tokens.is_valid()
        lengths = np.where(known, pc.fill_null(pc.list_value_length(tokens), 0), 0).astype(np.int64)
        flat, self.row = tokens.flatten(), np.repeat(np.arange(rows), lengths)
        if flat.null_count:
            self.row, flat = self.row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
        encoded = flat.dictionary_encode()
        self.code, self.words = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary

    def terms(self, bigrams: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, term, count) of the distinct words of each row and, with ``bigrams``, of its pairs of neighbours.

        A pair's number is the first code times the number of words, plus the second.
        """
        found = [_distinct(self.row, self.code, max(len(self.words), 1))]
        if bigrams:
            inside = self.row[1:] == self.row[:-1]
            found.append(_distinct(self.row[1:][inside], (self.code[:-1] * len(self.words) + self.code[1:])[inside], max(len(self.words), 1) ** 2))
        return found

    def names(self, kind: int, term: np.ndarray) -> pa.Array:
        if not kind:
            return self.words.take(pa.array(term))
        number = max(len(self.words), 1)
        return pc.binary_join_element_wise(self.words.take(pa.array(term // number)), self.words.take(pa.array(term % number)), " ")

    def buckets(self, kind: int, term: np.ndarray) -> np.ndarray:
        """The bucket of each term, the same in all tasks."""
        hashes = pd.util.hash_array(self.words.to_numpy(zero_copy_only=False), categorize=False)
        number = max(len(self.words), 1)
        x = hashes[term] if not kind else hashes[term // number] * _PAIR + hashes[term % number] + np.uint64(1)
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return ((x ^ (x >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def _distinct(row: np.ndarray, term: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count); the product of both does not leave 63 bits, as ``TOKENS`` and Arrow's batches are bounded."""
    key, n = np.unique(row * number + term, return_counts=True)
    return key // number, key % number, n


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Whole documents of about ``TOKENS`` tokens; ``tokens`` is the last column."""
    for batch in batches:
        tokens = batch.column(batch.num_columns - 1)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS, side="right")))
            part = batch.slice(lo, hi - lo)
            yield part, Words(len(part), part.column(part.num_columns - 1))
            lo = hi


def group_counts(tokenized: DataFrame) -> DataFrame:
    """``(grp, term, df, cf)`` of some whole documents each: parts of the sums that ``vocab.group_term_stats`` takes.

    A row comes back for each distinct term of a piece, not for each of its documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _pieces(batches):
            row, term, n = words.terms(False)[0]
            groups = pc.dictionary_encode(part.column(0), null_encoding="encode")
            number = max(len(words.words), 1)
            cell, at = np.unique(groups.indices.to_numpy()[row].astype(np.int64) * number + term, return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                groups.dictionary.take(pa.array(cell // number)), words.names(0, cell % number), pa.array(np.bincount(at, minlength=len(cell)).astype(np.int64)),
                pa.array(np.bincount(at, n, len(cell)).astype(np.int64))], ["grp", "term", "df", "cf"])

    kind = tokenized.schema["grp"].dataType.simpleString()
    return tokenized.select("grp", "tokens").mapInArrow(count, f"grp {kind}, term string, df bigint, cf bigint")


def frequent_buckets(tokenized: DataFrame, least: float, bigrams: bool = False) -> np.ndarray:
    """For each bucket, packed to bits, whether its terms have ``least`` documents or more, a document counted for each term.

    That sum is no smaller than the document frequency of any term of the bucket. Tasks' tables are added block by block; the
    driver gets a bit a bucket, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, words in _pieces(batches):
            for kind, (_, term, _) in enumerate(words.terms(bigrams)):
                total += np.bincount(words.buckets(kind, term), minlength=BUCKETS)
        for b in range(0, BUCKETS, BLOCK):
            if total[b:b + BLOCK].any():
                yield _blocks([b], [total[b:b + BLOCK]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(cells.as_buffer(), np.int64)
                sums[b] = sums[b] + part if b in sums else part
        for b, cells in sums.items():
            yield _blocks([b], [np.packbits(cells >= least)])

    schema = "block int, cells binary"
    out = np.packbits(np.full(BUCKETS, least <= 0))
    for r in tokenized.select("tokens").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():
        out[r["block"] // 8:(r["block"] + BLOCK) // 8] = np.frombuffer(r["cells"], np.uint8)
    return out


def _blocks(blocks: list[int], cells: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary())], ["block", "cells"])


def frequent_cells(tokenized: DataFrame, least: float, bigrams: bool = False, key: str = "doc_id") -> DataFrame:
    """``(doc_id, grp, cells)``: a row a document with ``(term, tf)`` of the terms that may lie in ``least`` documents.

    No term of that document frequency is missing; a few others, which share a bucket with one, are there too.
    """
    shared = tokenized.sparkSession.sparkContext.broadcast(frequent_buckets(tokenized, least, bigrams))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.unpackbits(shared.value).astype(bool)
        for part, words in _pieces(batches):
            rows, names, counts = [], [], []
            for kind, (row, term, n) in enumerate(words.terms(bigrams)):
                one, at = np.unique(term, return_inverse=True)
                may = open_[words.buckets(kind, one)]
                chosen = may[at]
                place = np.cumsum(may) - 1
                rows.append(row[chosen])
                names.append(words.names(kind, one[may]).take(pa.array(place[at[chosen]])))
                counts.append(n[chosen])
            row = np.concatenate(rows)
            order = np.argsort(row, kind="stable")
            flat = pa.StructArray.from_arrays([pa.concat_arrays(names).take(pa.array(order)), pa.array(np.concatenate(counts)[order].astype(np.int64))], ["term", "tf"])
            bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(part))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(bounds), flat)], [key, "grp", "cells"])

    kind = tokenized.schema[key].dataType.simpleString()
    return tokenized.select(key, "grp", "tokens").mapInArrow(cells, f"{key} {kind}, grp string, cells array<struct<term: string, tf: bigint>>")
