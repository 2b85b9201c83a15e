"""Quality rules: divergence of a text's histograms from its language's, with guards for short texts.

Two histograms describe a text: its character classes (code points) and its common words (hashed words, of which the
``COMMON`` most frequent of the language have a bin each and the others share one). The references are the summed
histograms of all texts of the language, gathered over the whole corpus; texts without a language share one reference.
A text fails if the Jensen-Shannon distance (base 2, so 0 to 1) to its reference exceeds the limit of either histogram.
Texts with fewer than ``MIN_CHARS`` characters or ``MIN_WORDS`` words are too short for a histogram and pass that test.

The base rules come first: fewer than 20 words, or more than 30 % of the words in 8-word windows that occur more than once.

Defined results: null and empty texts have zero counts and fail the base; repeated rows are judged alike and each count in
the references; other columns are kept, columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.llm.buffers import (BYTE_VALUES, LOWER_VALUES, VISIBLE, Prefix, collect_vectors, covered, per_row, summed_vectors,
                                   text_chunks, with_text_columns, words)

WORD_BINS = 1 << 14
COMMON = 100
CLASSES = 7
MIN_CHARS, MIN_WORDS = 200, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.6
MAX_LANGUAGES = 512
UNNAMED = "\0"  # the reference of texts without a language
REPEAT_WINDOW = 8

# Class of each byte; bytes that continue a character have none.
LOWERCASE, UPPERCASE, DIGIT, BLANK, POINT, SYMBOL, OTHER, NONE = range(8)
_CLASS = np.full(256, SYMBOL, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = LOWERCASE, UPPERCASE, DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = POINT
_CLASS[0xC0:], _CLASS[0x80:0xC0] = OTHER, NONE
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIELDS = [T.StructField(n, T.LongType()) for n in COUNTS] + [
    T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()),
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]


def class_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.bincount(row * 8 + _CLASS[data], minlength=8 * (len(bounds) - 1)).reshape(-1, 8)[:, :CLASSES]


def word_bins(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (Prefix(LOWER_VALUES[data]).spans(start, end) & np.uint64(WORD_BINS - 1)).astype(np.int64)


def references(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, tuple]:
    """``{language: (character class shares, common bins, shares of these bins and of the rest)}``."""
    size = WORD_BINS + CLASSES

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for lo, hi, data, bounds in text_chunks(batch.column("text")):
                own, of = np.unique(np.array(names[lo:hi], object), return_inverse=True)
                start, end, row = words(data, bounds, VISIBLE)
                cells = np.bincount(of[row] * WORD_BINS + word_bins(data, start, end),
                                    minlength=len(own) * WORD_BINS).reshape(-1, WORD_BINS)
                classes = class_counts(data, bounds)
                for i, name in enumerate(own):
                    have = sums.setdefault(name, np.zeros(size, np.int64))
                    have[:WORD_BINS] += cells[i]
                    have[WORD_BINS:] += classes[of == i].sum(axis=0)
        return sums

    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNNAMED)).alias("lang"), F.col(text).alias("text"))
    out = {}
    for name, sums in collect_vectors(summed_vectors(named, count, size), size, MAX_LANGUAGES).items():
        cells, classes = sums[:WORD_BINS], sums[WORD_BINS:]
        common = np.sort(np.lexsort((np.arange(WORD_BINS), -cells))[:COMMON])
        shares = np.append(cells[common], cells.sum() - cells[common].sum())
        out[name] = (classes / max(1, classes.sum()), common, shares / max(1, shares.sum()))
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q``, base 2."""
    m = (p + q) / 2

    def divergence(a):
        return (a * np.log2(np.divide(a, m, out=np.ones_like(m), where=(a > 0) & (m > 0)))).sum(axis=1)
    return np.sqrt(np.clip((divergence(p) + divergence(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def repeated_lines(data: np.ndarray, bounds: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that are equal to an earlier line of the same text, by text."""
    n = len(bounds) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((bounds[:-1][bounds[:-1] < bounds[1:]], breaks + 1)))
    start = np.unique(start[start < len(data)])
    row = np.searchsorted(bounds, start, "right") - 1
    stop = np.append(breaks, len(data))
    end = np.minimum(stop[np.searchsorted(stop, start)], bounds[row + 1])
    full = np.searchsorted(word_starts, start) < np.searchsorted(word_starts, end)
    start, end, row = start[full], end[full], row[full]
    h = Prefix(BYTE_VALUES[data]).spans(start, end)
    order = np.lexsort((end - start, h, row))
    h, size, row = h[order], (end - start)[order], row[order]
    again = (h[1:] == h[:-1]) & (size[1:] == size[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][again], minlength=n)


def repeated_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words in windows of ``REPEAT_WINDOW`` words that occur twice or more in the same text, by text."""
    if len(start) < REPEAT_WINDOW:
        return np.zeros(n, np.int64)
    windows = Prefix(Prefix(BYTE_VALUES[data]).spans(start, end)).windows(REPEAT_WINDOW)
    at = np.flatnonzero(row[:len(windows)] == row[REPEAT_WINDOW - 1:])
    order = at[np.lexsort((windows[at], row[at]))]
    same = (windows[order][1:] == windows[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return np.bincount(row[covered(order[twice], REPEAT_WINDOW, len(start))], minlength=n)


def judge(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Adds the counts, both distances (null for a text too short to compare), ``base_failed`` and ``kept``."""
    model = docs.sparkSession.sparkContext.broadcast(references(docs, lang, text))
    named = docs.withColumn("_lang", F.coalesce(F.col(lang).cast("string"), F.lit(UNNAMED)))
    fields = [f for f in FIELDS if f.name not in ("base_failed", "kept")]

    def make():
        refs = model.value
        names = {name: i for i, name in enumerate(refs)}
        tables = list(refs.values())
        slot = np.full((len(tables), WORD_BINS), COMMON, np.int64)
        for i, (_, common, _) in enumerate(tables):
            slot[i, common] = np.arange(len(common))

        def compute(data: np.ndarray, bounds: np.ndarray, langs: list[str]):
            n = len(bounds) - 1
            start, end, row = words(data, bounds, VISIBLE)
            of = np.array([names.get(x, 0) for x in langs])
            count = np.bincount(row, minlength=n)
            letters = np.zeros(len(data) + 1, np.int64)
            np.cumsum(VISIBLE[data] & ((data & 0xC0) != 0x80), out=letters[1:])
            classes = class_counts(data, bounds)
            chars = classes.sum(axis=1)
            bins = np.bincount(row * (COMMON + 1) + slot[of[row], word_bins(data, start, end)],
                               minlength=n * (COMMON + 1)).reshape(n, COMMON + 1)
            by_char, by_word = np.full(n, np.nan), np.full(n, np.nan)
            long = (chars >= MIN_CHARS) & (count >= MIN_WORDS)
            for i, (class_shares, _, word_shares) in enumerate(tables):
                mine = np.flatnonzero(long & (of == i))
                if len(mine):
                    by_char[mine] = distance(classes[mine] / chars[mine, None], class_shares)
                    by_word[mine] = distance(bins[mine] / count[mine, None], word_shares)
            return [count, letters[bounds[1:]] - letters[bounds[:-1]], per_row(SYMBOLS[data], bounds),
                    repeated_lines(data, bounds, start), repeated_words(data, start, end, row, n),
                    pa.array(by_char, from_pandas=True), pa.array(by_word, from_pandas=True)]
        return compute

    judged = with_text_columns(named, fields, make, text, beside="_lang").drop("_lang")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    diverges = F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(
        F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return judged.withColumns({"base_failed": failed, "kept": ~failed & ~diverges})
