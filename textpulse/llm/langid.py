"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is additive: every task counts hashed n-grams of the letters in its labelled texts, the counts are summed by
language and block, and the log-probability matrix (languages x ``FEATURES``, of fixed size) is broadcast. Scoring
gathers the n-gram columns of a chunk of texts and sums them per text.

The posterior says which of the learned languages a text is, and comes near 1 after a few words whatever the text. Whether it is in
that language at all is said by ``fit``, the mean log-likelihood of its n-grams, against a limit for the language from labelled
texts that were held out from counting.

Letters are lower-cased and everything else reads as a space, so digits, mark-up and punctuation say nothing about a language.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0; rows without a label teach nothing;
without any labelled row every text is ``und``; a language without held-out texts takes its limit from those of all languages, and
without any there is no limit; repeated rows count as often as they occur; of equal scores the first
language in alphabetical order wins; other columns are kept, columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.llm.buffers import SMALL_CHUNK_BYTES, collect_vectors, summed_vectors, text_chunks, with_text_columns

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MAX_LANGUAGES = 512  # bounds the broadcast matrix: 512 x 65,536 x 4 bytes = 128 MB
DOCUMENTS = FEATURES  # the cell after the features counts documents
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())]
CHANCE = -float(np.log(FEATURES))  # fit of a text to a model that knows nothing
LEAST_GAIN = 1 / 3  # of the gain over chance that the median held-out text of the language has
LEAST_KEPT = 0.99  # of the held-out texts of the language pass in any case


@cache
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their rows, and the number of letters of each row."""
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = heads[bounds]
    # One capital letter of Unicode becomes two code points in lower case; it is replaced first, so positions hold.
    text = data.tobytes().decode("utf-8", "replace").replace("İ", "i").lower()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32))
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    found, rows = [], []
    mixed = code * np.uint32(0x9E3779B1)
    state, some = mixed, letter
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            state = (state[:-1] * np.uint32(0x85EBCA6B)) ^ mixed[n - 1:]
            some = some[:-1] | letter[n - 1:]
        if n in ORDERS and len(state):
            keep = np.flatnonzero(some & (row[:len(row) - n + 1] == row[n - 1:]))
            h = state[keep] + np.uint32(n)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            found.append(((h ^ (h >> np.uint32(13))) & np.uint32(FEATURES - 1)).astype(np.int32))
            rows.append(row[keep])
    letters = np.concatenate(([0], np.cumsum(letter)))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), letters[at[1:]] - letters[at[:-1]]
    return np.concatenate(found), np.concatenate(rows), letters[at[1:]] - letters[at[:-1]]


def train(docs: DataFrame, label: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities, its last column the log share of documents."""
    labelled = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for lo, hi, data, bounds in text_chunks(batch.column("text"), SMALL_CHUNK_BYTES):
                names, of = np.unique(np.array(labels[lo:hi], object), return_inverse=True)
                feature, row, letters = features(data, bounds)
                cells = np.bincount(of[row] * FEATURES + feature, minlength=len(names) * FEATURES).reshape(-1, FEATURES)
                spoken = np.bincount(of[letters > 0], minlength=len(names))
                for i, name in enumerate(names):
                    have = sums.setdefault(name, np.zeros(FEATURES + 1, np.int64))
                    have[:FEATURES] += cells[i]
                    have[DOCUMENTS] += spoken[i]
        return sums

    counts = collect_vectors(summed_vectors(labelled, count, FEATURES + 1), FEATURES + 1, MAX_LANGUAGES)
    names = sorted(n for n, v in counts.items() if v[DOCUMENTS])
    matrix = np.zeros((len(names), FEATURES + 1), np.float32)
    documents = sum(counts[n][DOCUMENTS] for n in names)
    for i, name in enumerate(names):
        cells = counts[name][:FEATURES] + SMOOTHING
        matrix[i, :FEATURES] = np.log(cells / cells.sum())
        matrix[i, DOCUMENTS] = np.log(counts[name][DOCUMENTS] / documents)
    return names, matrix


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score``, the posterior probability of the language given the text, and ``fit``, the mean
    log-likelihood of the text's n-grams in that language, null for ``und``."""
    model = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def make():
        languages, logs = model.value
        choice = np.array([*languages, "und"], object)

        def compute(data: np.ndarray, bounds: np.ndarray):
            feature, row, letters = features(data, bounds)
            n = len(letters)
            if not languages:
                return [["und"] * n, np.zeros(n), pa.nulls(n, pa.float64())]
            sums = np.stack([np.bincount(row, logs[i][feature], n) + logs[i][DOCUMENTS] for i in range(len(languages))])
            best = sums.argmax(axis=0)
            score = 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
            fit = (sums[best, np.arange(n)] - logs[best, DOCUMENTS]) / np.maximum(1, np.bincount(row, minlength=n))
            unknown = letters == 0
            best[unknown], score[unknown], fit[unknown] = len(languages), 0.0, np.nan
            return [pa.array(choice[best], pa.string()), score, pa.array(fit, from_pandas=True)]
        return compute

    return with_text_columns(docs, FIELDS, make, text, limit=SMALL_CHUNK_BYTES)


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """True for a fixed fifth of the keys, never for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", label: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; learns from labelled rows with a key that is not held out."""
    learn = docs.where(F.col(key).isNotNull() & ~held_out(key))
    return predict(docs.withColumn("held_out", held_out(key)), *train(learn, label, text), text=text)


def fit_limits(tried: DataFrame, label: str = "lang") -> dict[str | None, float]:
    """The least ``fit`` of each language, and of all under ``None``, from held-out texts whose label was predicted.

    One histogram a language, summed over all its texts, in steps of a hundredth.
    """
    cells = tried.where((F.col(label).cast("string") == F.col("lang_pred")) & F.col("fit").isNotNull()).groupBy(
        "lang_pred", F.round("fit", 2).alias("fit")).count().collect()
    bins: dict[str | None, dict[float, int]] = {}
    for cell in cells:
        for name in (cell["lang_pred"], None):
            have = bins.setdefault(name, {})
            have[cell["fit"]] = have.get(cell["fit"], 0) + cell["count"]
    out = {}
    for name, have in bins.items():
        at = np.array(sorted(have))
        below = np.cumsum([have[x] for x in at])
        median = at[np.searchsorted(below, below[-1] / 2)]
        lowest = at[np.searchsorted(below, (1 - LEAST_KEPT) * below[-1], "right")] - 0.01
        out[name] = float(min(CHANCE + LEAST_GAIN * (median - CHANCE), lowest))
    return out


def certain(docs: DataFrame, least: float, key: str = "doc_id", label: str = "lang", text: str = "text") -> DataFrame:
    """Rows of ``docs`` in a learned language: ``score`` is at least ``least`` and ``fit`` at least the language's limit."""
    names, matrix = train(docs.where(F.col(key).isNotNull() & ~held_out(key)), label, text)
    aside = docs.where(held_out(key) & F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    limits = fit_limits(predict(aside, names, matrix), "label")
    rest = limits.pop(None, -np.inf)
    known = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)) if limits else None
    limit = F.lit(rest) if known is None else F.coalesce(F.element_at(known, F.col("lang_pred")), F.lit(rest))
    found = predict(docs, names, matrix, text)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least) & (F.col("fit") >= limit))
