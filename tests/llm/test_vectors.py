"""Operators on vectors and the binary token records, against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpulse.llm import codes, negatives, records, tokens
from textpulse.llm.queries import TOKENIZER

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, anchor string, _v string, _code string, _label string, score string"


def vectors(n=400, dims=16, seed=3, copies=150):
    """Rows with clashing columns: random vectors, one vector a third of them share, and every odd row."""
    rng = np.random.default_rng(seed)
    common = rng.normal(size=dims).round(3)
    rows = []
    for i in range(n):
        v = common if i % 8 < 8 * copies / n else rng.normal(size=dims).round(3)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 4)), "a", "b", "c", "d", "e", "f"))
    full = list(rows)
    odd = [(n, None, 1), (n + 1, [1.0, None] * (dims // 2), 1), (n + 2, [math.nan] * dims, 1), (n + 3, [math.inf] * dims, 2), (n + 4, [], 0),
           (n + 5, [0.5] * (dims - 3), 3), (None, [0.25] * dims, 1), (n + 6, [0.1] * dims, None), (100, full[100][1], full[100][2]), (300, [9.0] * dims, 9)]
    return full + [(*r, "a", "b", "c", "d", "e", "f") for r in odd]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floored(v, dims):
    return tuple([math.floor(256 * x) for x in v] + [0] * (dims - len(v)))


def brute_negatives(rows, dims, every, positives=5, negatives=10, window=(30, 90)):
    kept = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and finite(v):
            kept[i] = min(kept.get(i, (label, floored(v, dims))), (label, floored(v, dims)))
    out = []
    for a, (label, q) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            found = [(i, -t) for t, i, other in scored if other != label and window[0] * -s <= 100 * -t <= window[1] * -s]
            out += [(a, p, rank + 1, i, -s, t) for rank, (i, t) in enumerate(found[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("anchors, tile, alone", [(4096, 64, 0.25), (3, 2, 2.0), (5, 2, 0.0)])
def test_negatives(spark, monkeypatch, anchors, tile, alone):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "TILE", tile)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("id") % 50 == 0).collect())
    assert got == brute_negatives(rows, 16, 50) and len({r[0] for r in got}) > 5


def test_a_step_leaves_out_what_cannot_reach_the_range():
    rng = np.random.default_rng(5)
    q, data = rng.integers(-90, 90, (7, 24)), rng.integers(-90, 90, (24, 500)).astype(np.int32)
    block = negatives.Block(np.arange(7), np.zeros(7), q.astype(float))
    exact = q @ data
    low, high = np.quantile(exact, 0.98, axis=1).round(), np.full(7, np.inf)
    seen = {}
    for part in (slice(0, 4), slice(4, 7)):
        start = np.ones((part.stop - part.start, 500), bool)
        for a, found, scores in negatives.resolve(block, data, start, low, high, part):
            assert (scores == exact[a, found]).all()
            seen[a] = set(found)
    assert all(seen[a] == set(np.flatnonzero(exact[a] >= low[a])) for a in range(7))


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none, F.col("id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, *"abcdef")], SCHEMA)
    assert negatives.mine(one, F.col("id") % 2 == 0).count() == 0
    empty = spark.createDataFrame([(i, [], i % 2, *"abcdef") for i in range(6)], SCHEMA)
    got = negatives.mine(empty, F.col("id") == 0).select("positive_id", "negative_id", "negative_score").collect()
    assert sorted(map(tuple, got)) == [(p, n, 0) for p in (2, 4) for n in (1, 3, 5)]


def brute_codes(rows, parts, entries, rounds=2):
    kept = [(r[0], r[1], r[2]) for r in rows if finite(r[1])]
    wide = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    cut = lambda v: np.array(floored(v, wide)).reshape(parts, -1)
    cuts = [cut(v) for _, v, _ in kept]
    smallest = {}
    for (i, v, _) in kept:
        if i is not None:
            smallest[i] = min(smallest.get(i, floored(v, wide)), floored(v, wide))
    books = np.array([np.array(smallest[i]).reshape(parts, -1) for i in sorted(smallest)[:entries]]).transpose(1, 0, 2)
    for r in range(rounds + 1):
        near = [[min((int(((c[p] - e) ** 2).sum()), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cuts]
        if r < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [c[p] for c, n in zip(cuts, near) if n[p][1] == k]
                    if own:
                        books[p, k] = [math.floor(x) for x in np.sum(own, axis=0).astype(int) / len(own)]
    error = [sum(d for d, _ in n) for n in near]
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in n), e, by_label[label]) for (i, _, label), n, e in zip(kept, near, error)), key=str), books


@pytest.mark.parametrize("parts, entries", [(4, 64), (16, 20), (3, 500)])
def test_codes(spark, parts, entries):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    coded, books = codes.coded(df, parts=parts, entries=entries)
    want, expect = brute_codes(rows, parts, entries)
    assert (books == expect).all()
    assert codes.digest(books) == hashlib.sha256(",".join(str(x) for x in expect.ravel()).encode()).hexdigest()
    code = F.transform("_code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")) if entries <= 256 else None
    assert set(coded.columns) == {*df.columns, "_error", "_label_error"} and dict(coded.dtypes)["_v"] == "string"
    if code is not None:
        assert sorted((tuple(r) for r in coded.select("vec_id", F.array_join(code, ""), "_error", "_label_error").collect()), key=str) == want


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert codes.coded(none)[0].count() == 0
    nulls = spark.createDataFrame([(None, [1.0], 1, *"abcdef"), (1, None, 1, *"abcdef")], SCHEMA)
    assert codes.coded(nulls)[0].count() == 0
    empty = spark.createDataFrame([(1, [], None, *"abcdef"), (2, [], None, *"abcdef")], SCHEMA)
    assert {tuple(r) for r in codes.coded(empty)[0].select("_error", "_label_error").collect()} == {(0, 0)}


@pytest.mark.parametrize("reach, entries, degree", [(1, 64, 8), (40, 64, 8), (40, 300, 3), (2000, 5, 8)])
def test_tree_finds_the_first_of_the_nearest(reach, entries, degree):
    rng = np.random.default_rng(reach)
    points, asked = rng.integers(-reach, reach + 1, (entries, 3)), rng.integers(-reach, reach + 1, (2000, 3))
    points[entries // 2] = points[0]
    tree = codes.Tree(points, degree)
    entry, square = tree.nearest(asked)
    exact = ((asked[:, None] - points[None]) ** 2).sum(axis=2)
    assert (entry == exact.argmin(axis=1)).all() and (square == exact.min(axis=1)).all()
    assert reach == 1 or entries < 10 or tree.measured < 0.8 * exact.size  # subtrees are left out


def crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert crc32c(b"123456789") == 0xE3069283
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (9, 0, 1, 255, 256, 257, 5000, 3)] + [b"123456789"]
    at = np.cumsum([0, *map(len, parts)])
    got = records.masked_crcs(np.frombuffer(b"".join(parts), np.uint8), at[:-1], at[1:])
    assert got.tolist() == [((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF for c in map(crc32c, parts)]


TEXTS = ["", " ", "a", "  two  blanks ", "line\n next\n\n  line ", "<|endoftext|> and <|endoftext|>x", "don't it's 12 3.5 !? ...", "naïve é à  b　 c", "😀 x 😀  y",
         "\t tab \r\n x", "end. ", "x" * 3000 + " tail", "a b. c, d! e"]


def encoded(texts):
    raw = [t.encode() for t in texts]
    return tokens.encoder(TOKENIZER)(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def odd_texts(n=3000):
    rng = random.Random(7)
    letters = ["a", "b", "X", "é", "ß", "×", "ñ", "ō", " ", " ", "  ", "\n", "\n", "\t", ".", ",", "!", "'s", "7", "\u00a0", "\u3000", "😀", "e\u0301", "<|endoftext|>", "the", "und"]
    return TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("remembered", [300_000, 50])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, remembered):
    from tokenizers import Tokenizer
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    tokens.encoder.cache_clear()
    whole, texts = Tokenizer.from_file(TOKENIZER), odd_texts()
    for lo in range(0, len(texts), 500):
        ids, counts = encoded(texts[lo:lo + 500])
        at = np.cumsum([0, *counts])
        for i, t in enumerate(texts[lo:lo + 500]):
            assert ids[at[i]:at[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert encoded([])[1].tolist() == [] and encoded(["", ""])[1].tolist() == [0, 0]


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    want = encoded(TEXTS)
    monkeypatch.setattr(tokens.Prefix, "spans", lambda self, start, end: (end - start).astype(np.uint64))
    got = encoded(TEXTS)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer
    lower = TOKENIZER.replace("byte_bpe_50k", "word_bpe_49k")
    whole = Tokenizer.from_file(lower)
    raw = [t.encode() for t in TEXTS]
    ids, counts = tokens.encoder(lower)(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert ids.tolist() == [i for t in TEXTS for i in whole.encode(t, add_special_tokens=False).ids] and counts.sum() == len(ids)


def brute_records(rows):
    from tokenizers import Tokenizer
    whole, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("ranges", [None, 1, 5])
def test_records_round_trip(spark, docs, corpus, tmp_path, ranges):
    path = str(tmp_path / "records")
    got = records.round_trip(docs, path, TOKENIZER, 2, ranges=ranges).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute_records([r[:2] for r in corpus])
    # Every record again, by its offset, in an order of the seed's.
    entries = records.index(spark, path)
    found = records.shuffled(spark, path, 11).collect()
    kept = {(r["file"], r["at"]): (r["doc_id"], r["ids_crc32"]) for r in entries.collect()}
    assert {(r["file"], r["at"]): (r["doc_id"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in found} == kept
    assert [(r["file"], r["at"]) for r in found] != sorted(kept)
    some = records.fetch(spark, path, entries.where("doc_id = 107")).collect()
    assert [r["doc_id"] for r in some] == [107]


def test_repeated_rows_are_spread(spark, tmp_path):
    rows = [(5, "the same text")] * 300 + [(i, f"text {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    path = str(tmp_path / "records")
    got = records.round_trip(df, path, TOKENIZER, 2, ranges=8).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute_records(rows)
    assert records.index(spark, path).where("doc_id = 5").select("file").distinct().count() > 2


def test_wide_ids_and_a_changed_byte():
    made = records.frames([1, None], np.array([70000, 5, 6], np.uint32), np.array([2, 1])) + records.empty_record()
    at, size = records._records(made)
    assert [(k, i.tolist()) for k, i in (records.payload(made, a, s) for a, s in zip(at.tolist(), size.tolist()))] == [(1, [70000, 5]), (None, [6])]
    records._verify(np.frombuffer(made, np.uint8), at, size)
    for place in (at[1] + 3, at[1] + records.HEAD + 1):
        with pytest.raises(ValueError):
            changed = bytearray(made)
            changed[place] ^= 1
            records._verify(np.frombuffer(bytes(changed), np.uint8), at, size)
    with pytest.raises(ValueError):
        records._records(made[:-9])


def test_records_of_nothing(spark, none, tmp_path):
    assert records.round_trip(none, str(tmp_path / "records"), TOKENIZER, 2).count() == 0
