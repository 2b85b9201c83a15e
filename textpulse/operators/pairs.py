"""Sums of products of two terms over the documents of a group (J9): the shared core of A3 and A5.

Three exact ways to the same ``(grp, a, b, s)``:

* ``pair_sums_for`` joins the chosen terms' rows to the other rows of the same documents. Its size is the number of
  cells in the documents that contain a chosen term.
* ``pair_sums_all`` is for a capped vocabulary, whose matrix of cells a task can hold: each task folds the documents it
  has into one matrix per group and emits one row per *cell*. Documents are range-partitioned by (group, document), which cuts
  a group holding a third of the corpus into as many partitions as its size asks for.
* ``cell_sums`` is for a vocabulary of any size over short texts: documents are dealt by group and range of term numbers, a task
  forms the pairs of its range inside the document's row and adds them in an array of fixed size. What is shuffled after that is a row
  a cell and not a row a pair or task; a range with very many pairs is dealt to several tasks by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpulse.operators.ordinals import row_numbers
from textpulse.operators.sizes import small
from textpulse.session import stored

CHUNK_DOCS = 2048
ROWS_PER_TASK = 250_000
CELLS = 1 << 23  # sums a task holds, 9 bytes each; or those of one term with all others
CHUNK_PAIRS = 1 << 18  # formed at once, or those of one term of a document
PAIRS_PER_TASK = 1 << 20
PAIRS_PER_RANGE = 1 << 27  # beyond which a range of terms is dealt to several tasks


def number_terms(vocab: DataFrame) -> DataFrame:
    """``term_id`` 0..V-1 in term order, for a capped vocabulary: one task sees all of its terms."""
    return vocab.withColumn("term_id", F.row_number().over(Window.orderBy("term")) - 1)


def _total(cells: DataFrame) -> DataFrame:
    return cells.groupBy("grp", "a", "b").agg(F.sum("s").alias("s"))


def pair_sums_for(rows: DataFrame, chosen: DataFrame, value: str, key: str = "doc_id") -> DataFrame:
    """Pairs (a, b) of term ids, a of ``chosen.term_id``, b any term of the same document, a = b included."""
    left = rows.join(chosen, "term_id", "left_semi").select(key, "grp", F.col("term_id").alias("a"), F.col(value).alias("_x"))
    right = rows.select(key, F.col("term_id").alias("b"), F.col(value).alias("_y"))
    return _total(left.join(right, key).select("grp", "a", "b", (F.col("_x") * F.col("_y")).alias("s")))


def pair_sums_all(rows: DataFrame, value: str, key: str = "doc_id", n_rows: int | None = None) -> DataFrame:
    """Every co-occurring pair of term ids with ``a <= b``; ids count from 0 and stay below the vocabulary's cap.

    The number of range partitions is given, because folding costs far more than the size of its input suggests and
    adaptive execution would merge small partitions into too few tasks. It follows ``n_rows`` where that is known.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n_rows is not None:
        tasks = max(tasks, -(-n_rows // ROWS_PER_TASK))
    return _total(
        rows.where(F.col("grp").isNotNull())
        .select("grp", F.col(key).alias("doc"), F.col("term_id").cast("int").alias("t"),
                F.col(value).cast("double").alias("x"))
        .repartitionByRange(tasks, "grp", "doc").sortWithinPartitions("grp", "doc")
        .mapInPandas(_fold, "grp string, a int, b int, s double"))


def cell_sums(rows: DataFrame, value: str, key: str = "doc_id", n_terms: int | None = None) -> DataFrame:
    """Every co-occurring pair of term ids with ``a < b``, for any vocabulary.

    With ``n_terms`` ids count from 0 and stay below it; other ids are numbered first.
    """
    if n_terms is None:
        numbers = stored(row_numbers(rows.select("term_id").distinct(), "term_id", name="_t"), "term-numbers")
        n = numbers.count()
        numbered = rows.join(small(numbers, n), "term_id").select(key, "grp", (F.col("_t") - 1).alias("term_id"), value)
        names = small(numbers.select(F.col("term_id").alias("_id"), (F.col("_t") - 1).alias("_t")), n)
        sums = cell_sums(numbered, value, key, n)
        for side in "ab":
            sums = sums.join(names, sums[side] == F.col("_t")).withColumn(side, F.col("_id")).drop("_id", "_t")
        return sums
    whole = stored(rows.where(F.col("grp").isNotNull()).groupBy(key, "grp").agg(F.sort_array(F.collect_list(
        F.struct(F.col("term_id").cast("int").alias("t"), F.col(value).cast("double").alias("x")))).alias("_cells")), "document-cells")
    size = F.size("_cells")
    n_pairs = whole.agg(F.sum(size.cast("long") * (size - 1) / 2)).first()[0] or 0
    width = max(1, CELLS // max(n_terms, 1))
    ranges = max(1, -(-n_terms // width))
    split = max(1, -int(-n_pairs // (ranges * PAIRS_PER_RANGE)))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * ranges * split, -int(-n_pairs // PAIRS_PER_TASK)))
    place = lambda c: F.floor(c["t"] / F.lit(width)).cast("int")
    # A range gets a document's cells from its own first one on, unless that is the last of all, which has no pair.
    found = whole.select("grp", F.pmod(F.xxhash64(key), F.lit(split)).alias("_part"), "_cells",
                         F.array_distinct(F.transform("_cells", place)).alias("_ranges"))
    alone = (size == 1) | (place(F.get("_cells", size - 1)) != place(F.get("_cells", size - 2)))
    dealt = found.select("grp", "_part", "_cells", F.explode(F.slice("_ranges", F.lit(1), F.size("_ranges") - alone.cast("int"))).alias("_range"))
    dealt = dealt.select("grp", "_part", "_range", F.filter("_cells", lambda c: c["t"] >= F.col("_range") * width).alias("_cells"))
    dealt = dealt.repartition(tasks, "grp", "_range", "_part").sortWithinPartitions("grp", "_range").select("grp", "_range", "_cells")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _add_cells(batches, n_terms, width)

    return _total(dealt.mapInArrow(add, "grp string, a bigint, b bigint, s double"))


def _add_cells(batches: Iterator[pa.RecordBatch], n_terms: int, width: int) -> Iterator[pa.RecordBatch]:
    """Documents' cells (grp, range, cells), one group and range after the other, in; sums over the pairs whose first term is in the
    range out. Holds the sums of one range of ``width`` terms and one chunk of pairs."""
    sums, met = np.zeros(width * n_terms), np.zeros(width * n_terms, bool)
    now = None

    def flush():
        cells = np.flatnonzero(met)
        for lo in range(0, len(cells), 1 << 16):
            at = cells[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([
                pa.array([now[0]] * len(at), pa.string()), pa.array(at // n_terms + now[1] * width), pa.array(at % n_terms), pa.array(sums[at])], ["grp", "a", "b", "s"])
        sums[cells], met[cells] = 0.0, False

    def add(t: np.ndarray, x: np.ndarray, bounds: np.ndarray, base: int):
        """Pairs of each cell of the range with the later cells of its document."""
        after = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(t)) - 1
        after[t >= base + width] = 0
        until = np.concatenate(([0], np.cumsum(after)))
        lo = 0
        while lo < len(t):
            hi = max(lo + 1, int(np.searchsorted(until, until[lo] + CHUNK_PAIRS, "right")) - 1)
            n = after[lo:hi]
            other = np.repeat(np.arange(lo, hi) + 1 - (until[lo:hi] - until[lo]), n) + np.arange(until[hi] - until[lo])
            at = np.repeat((t[lo:hi] - base) * n_terms, n) + t[other]
            np.add.at(sums, at, np.repeat(x[lo:hi], n) * x[other])
            met[at] = True
            lo = hi

    for batch in batches:
        if not len(batch):
            continue
        group, place, cells = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(2)
        code, bounds = group.indices.to_numpy(), cells.offsets.to_numpy().astype(np.int64)
        t, x = (cells.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        t = t.astype(np.int64)
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (place[1:] != place[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
            here = group.dictionary[int(code[lo])].as_py(), int(place[lo])
            if here != now:
                if now is not None:
                    yield from flush()
                now = here
            own = slice(bounds[lo], bounds[hi])
            add(t[own], x[own], bounds[lo:hi + 1] - bounds[lo], now[1] * width)
    if now is not None:
        yield from flush()


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both orders of every pair given once."""
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select("grp", F.inline(both), "s")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (grp, doc, t, x) rows in, upper-triangle cells out; holds one group's matrix and one chunk of rows."""
    group, matrix, rest = None, None, None

    def emit(a, b, s):
        return pd.DataFrame({"grp": group, "a": a.astype("int32"), "b": b.astype("int32"), "s": s})

    def flush():
        nonlocal matrix
        if matrix is not None:
            a, b = np.nonzero(np.triu(matrix))
            yield emit(a, b, matrix[a, b])
            matrix = None

    def fold(part: pd.DataFrame):
        """Add whole documents of the current group, chunk by chunk."""
        nonlocal matrix
        docs, terms, x = part["doc"].to_numpy(), part["t"].to_numpy(), part["x"].to_numpy()
        row = np.concatenate(([0], np.cumsum(docs[1:] != docs[:-1])))
        starts = np.searchsorted(row, np.arange(0, row[-1] + 1, CHUNK_DOCS))
        for lo, hi in zip(starts, [*starts[1:], len(row)]):
            used, col = np.unique(terms[lo:hi], return_inverse=True)
            dense = np.zeros((row[hi - 1] - row[lo] + 1, len(used)))
            dense[row[lo:hi] - row[lo], col] = x[lo:hi]
            size = 0 if matrix is None else len(matrix)
            if size <= used[-1]:
                grown = np.zeros((1 << int(used[-1]).bit_length(),) * 2)
                if size:
                    grown[:size, :size] = matrix
                matrix = grown
            matrix[np.ix_(used, used)] += dense.T @ dense

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = (pdf["grp"] == pdf["grp"].iloc[-1]) & (pdf["doc"] == pdf["doc"].iloc[-1])
        rest, whole = pdf[last], pdf[~last]  # the last document may go on in the next batch
        for name, part in whole.groupby("grp", sort=False):
            if name != group:
                yield from flush()
                group = name
            fold(part)
    if rest is not None and len(rest):
        if rest["grp"].iloc[0] != group:
            yield from flush()
            group = rest["grp"].iloc[0]
        fold(rest)
    yield from flush()
