"""Token ids of whole texts by a public tokenizer, computed on chunks of texts as byte arrays.

A byte-level BPE that splits texts by its usual pattern gives the same ids when a text is cut where the pattern always starts
anew: before a space or line break that follows a visible character, before punctuation that follows a letter, and after a line
break between visible characters. No piece of the pattern reaches over such a place, and what it matches from there on does not
depend on what lies before. So chunks are cut there, every distinct piece is encoded once a chunk, and pieces that a worker has met
are remembered up to a number. New pieces go to the tokenizer joined into one text; the ids' own lengths in bytes tell where
each piece ends. Any other tokenizer gets whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np

from textpulse.llm.buffers import BYTE_VALUES, Prefix

REMEMBERED = 150_000  # pieces; some 200 bytes each
STOPS = b",.;:!?)"
_BYTES = np.arange(256)
_GRAPHIC = (_BYTES > 0x20) & (_BYTES < 0x7F)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
_STOP = np.isin(_BYTES, list(STOPS))
_LATIN = 0xC3  # first byte of U+00C0 to U+00FF, none of which is a space; two are no letters
_SIGNS = (0x97, 0xB7)


def _cuttable(tokenizer) -> bool:
    """Whether the tokenizer is a byte-level BPE with the usual pattern and nothing that looks beyond a piece."""
    before = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    cut = set(STOPS.decode()) | {" ", "\n"}
    return (tokenizer.normalizer is None and tokenizer.truncation is None and tokenizer.padding is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
            and type(tokenizer.model).__name__ == "BPE" and not tokenizer.model.dropout
            and not any(t.lstrip or t.rstrip or t.single_word or t.normalized or cut & set(t.content) for t in tokenizer.get_added_tokens_decoder().values()))


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of all pieces of the texts ``data[bounds[i]:bounds[i + 1]]``."""
    n = len(data)
    start = np.zeros(n, bool)
    if n > 1:
        before, now = data[:-1], data[1:]
        latin = np.zeros(n - 1, bool)
        latin[1:] = (data[:-2] == _LATIN) & (before[1:] >= 0x80)
        visible = _GRAPHIC[before] | latin
        letter = _LETTER[before] | (latin & (before != _SIGNS[0]) & (before != _SIGNS[1]))
        start[1:] = (((now == 32) | (now == 10)) & visible) | (_STOP[now] & letter)
        start[2:] |= visible[:-1] & (before[1:] == 10) & _GRAPHIC[now[1:]]
    start[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return np.flatnonzero(start)


def _same_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct piece, and for every piece the number of the one it equals, byte by byte."""
    _, first, same = np.unique(Prefix(BYTE_VALUES[data]).spans(start, end), return_index=True, return_inverse=True)
    size, other = end - start, first[same]
    # Pieces follow each other without gaps, so the bytes to compare are the data in order.
    equal = size == size[other]
    if equal.all():
        equal = (data == data[np.repeat(start[other] - start, size) + np.arange(len(data))]).all()
    if not np.all(equal):  # two pieces of one hash
        raw, number = data.tobytes(), {}
        same = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(start.tolist(), end.tolist())])
        first = np.unique(same, return_index=True)[1]
    return first, same


class Pieces:
    """Ids of pieces: remembered ones, and those of the chunk at hand."""

    def __init__(self, whole: Callable, length: np.ndarray):
        self.whole, self.length = whole, length
        self.place: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _joined(self, pieces: list[bytes], between: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of pieces that may follow each other, with ``between`` set between them."""
        ids, _ = self.whole([between.join(pieces).decode()])
        reach = np.cumsum(self.length[ids])
        end = np.cumsum([len(p) + len(between) for p in pieces]) - len(between)
        begin = end - [len(p) for p in pieces]
        at = np.searchsorted(reach, end)
        lo = np.searchsorted(reach, begin, "right")
        if len(pieces) and ((reach[at] != end).any() or (lo > 0).any() and (reach[lo[lo > 0] - 1] != begin[lo > 0]).any()):
            raise ValueError("the tokenizer's ids do not follow the pieces of its pattern")
        count = at + 1 - lo
        return ids[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())], count

    def find(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and where in it those of each piece begin and end."""
        at = [self.place.get(p, -1) for p in pieces]
        new = [p for p, i in zip(pieces, at) if i < 0]
        if not new:
            at = np.array(at, np.int64)
            return self.ids, self.ends[at], self.ends[at + 1]
        kinds: tuple[list[bytes], ...] = [], [], []
        for p in new:
            ended = _GRAPHIC[p[-1]] or (len(p) > 1 and p[-2] == _LATIN)
            kinds[0 if ended and p[0] == 32 else 1 if ended and _GRAPHIC[p[0]] else 2].append(p)
        found = [self._joined(kinds[0], b""), self._joined(kinds[1], b"\n"), self.whole([p.decode() for p in kinds[2]])]
        learnt = list(chain(*kinds))
        ids = np.concatenate([self.ids, *(i for i, _ in found)])
        ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.concatenate([c for _, c in found]))))
        number = dict(zip(learnt, range(len(self.place), len(self.place) + len(learnt))))
        at = np.array([number[p] if i < 0 else i for p, i in zip(pieces, at)], np.int64)
        if len(self.place) + len(learnt) <= REMEMBERED:
            self.place.update(number)
            self.ids, self.ends = ids, ends
        return ids, ends[at], ends[at + 1]


@cache
def encoder(file: str) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """``f(data, bounds) -> (ids of all texts, number of ids of each)`` for the tokenizer of ``file``; kept by a worker for its next task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs in parallel
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)

    def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(f) for f in found], np.int64)

    if not _cuttable(tokenizer):
        return lambda data, bounds: whole([data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])])
    added = {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    length = np.zeros(max(vocabulary.values()) + 1, np.int64)  # in bytes: a byte is one character of the vocabulary
    for token, i in vocabulary.items():
        length[i] = added.get(i, len(token))
    pieces = Pieces(whole, length)

    def cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = cuts(data, bounds)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        end = np.append(start[1:], len(data))
        first, same = _same_pieces(data, start, end)
        raw = data.tobytes()
        ids, lo, hi = pieces.find([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
        lo, n = lo[same], (hi - lo)[same]
        after = np.concatenate(([0], np.cumsum(n)))
        out = ids[np.repeat(lo - after[:-1], n) + np.arange(after[-1])]
        return out, np.diff(after[np.searchsorted(start, bounds)])

    return cut
