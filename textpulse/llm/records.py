r"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is framed by lengths and masked checksums: the payload's length (8 bytes), its masked CRC-32C (4), the payload, and the
payload's masked CRC-32C (4), all little-endian. A payload is the document's id (8 bytes), the bytes of a token id (2), flags (2,
bit 0: the row has no id) and the token ids, in 2 bytes each if they fit.

Documents are put in order by a range partition, so a file holds a stretch of them and files follow each other by number. Files
are written by Spark's text sink, whose commit protocol survives lost executors and works on any file system Spark knows. A
row of the sink is some megabytes of whole records, and the separator that the sink adds is itself a record, the empty one, which
readers pass over. Reading takes whole files; their size is bounded by the number of ranges.

The index has a row for each record: file number, offset and length of the frame, document, ids before it in the file, number of
ids. It is made from the bytes that were written, whose checksums that pass verifies, and stored beside the files; any subset of
it in any order is a plan for a shuffled read.

Checksums are computed for many records at once: CRC-32C is linear, so records are cut into pieces, all pieces advance together, and
each piece's sum is shifted by the zero bytes that stand for what follows it.

Defined results: a null or empty text is an end id alone; rows come in the order of their ids, those without id first, several
rows of one id in the order of a hash of their texts; repeated rows are written each. Columns other than id and text are not written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpulse.llm.buffers import text_chunks
from textpulse.llm.tokens import encoder

POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected
MASK = 0xA282EAD8
PIECE = 256
TEXT_BYTES = 32 << 20  # of texts to a file
UNKNOWN = 1 << 56  # Spark's estimate for what is not a table is near 2**63
HEAD, TAIL, FACTS = 12, 4, 12
CHECKED_BYTES = 2 << 20
INDEX = "file bigint, at bigint, bytes bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


@cache
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


@cache
def _shift(power: int) -> np.ndarray:
    """The effect of ``2 ** power`` zero bytes on a register, as one table for each of its bytes."""
    if power:
        half = _shift(power - 1)
        return np.stack([_apply(half, t) for t in half])
    table = _byte_table()
    basis = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)])
    return table[basis & 255] ^ (basis >> 8)


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _shifted(x: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Registers after that many zero bytes."""
    x = x.copy()
    for power in range(int(zeros.max(initial=0)).bit_length()):
        some = np.flatnonzero(zeros >> power & 1)
        x[some] = _apply(_shift(power), x[some])
    return x


def masked_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of ``data[start[i]:end[i]]`` for all i."""
    size = end - start
    pieces = -(-size // PIECE)
    first = np.concatenate(([0], np.cumsum(pieces)))
    # Leading zero bytes leave an empty register as it is, so messages end where pieces end.
    room = np.zeros(first[-1] * PIECE, np.uint8)
    before = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    room[np.repeat(first[1:] * PIECE - size - before, size) + np.arange(size.sum())] = data[np.repeat(start - before, size) + np.arange(size.sum())]
    register = np.zeros(first[-1], np.uint32)
    step = np.stack([_apply(_shift(2), np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)])
    for word in np.ascontiguousarray(room.view("<u4").reshape(-1, PIECE // 4).T):
        register = _apply(step, register ^ word)
    after = np.repeat(first[1:], pieces) - 1 - np.arange(first[-1])
    register = _shifted(register, after * PIECE)
    total = np.zeros(len(size), np.uint32)
    full = pieces > 0
    if full.any():
        total[full] = np.bitwise_xor.reduceat(register, first[:-1][full])
    crc = ~(total ^ _shifted(np.full(len(size), 0xFFFFFFFF, np.uint32), size))
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frames(keys: list[int | None], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Records of documents whose token ids follow each other in ``ids``."""
    n = len(keys)
    wide = 2 if ids.max(initial=0) < 1 << 16 else 4
    payload = FACTS + counts * wide
    start = np.concatenate(([0], np.cumsum(HEAD + payload + TAIL)))
    out = np.zeros(start[-1], np.uint8)

    def put(at: np.ndarray, values: np.ndarray, size: int) -> None:
        out[at[:, None] + np.arange(size)] = values.astype(f"<u{size}").view(np.uint8).reshape(n, size)

    put(start[:-1], payload, 8)
    facts = start[:-1] + HEAD
    put(facts, np.array([k or 0 for k in keys], np.int64).view(np.uint64), 8)
    put(facts + 8, np.full(n, wide), 2)
    put(facts + 10, np.array([k is None for k in keys]), 2)
    # Everything has an even number of bytes, so ids are laid out as pairs of bytes.
    pairs, words = ids.astype(f"<u{wide}").view("<u2"), counts * (wide // 2)
    before = np.cumsum(words) - words
    out.view("<u2")[np.repeat((facts + FACTS) // 2 - before, words) + np.arange(len(pairs))] = pairs
    put(start[:-1] + 8, masked_crcs(out, start[:-1], start[:-1] + 8), 4)
    put(start[1:] - TAIL, masked_crcs(out, facts, facts + payload), 4)
    return out.tobytes()


@cache
def empty_record() -> bytes:
    head = np.zeros(8, np.uint8)
    at = np.array([0]), np.array([8]), np.array([0])
    return bytes(8) + masked_crcs(head, at[0], at[1]).tobytes() + masked_crcs(head, at[2], at[2]).tobytes()


def _ranges(docs: DataFrame) -> int:
    """Ranges of about ``TEXT_BYTES``, and some for every core; Spark's own number where it does not know the size."""
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(3 * spark.sparkContext.defaultParallelism, -(-size // TEXT_BYTES))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> None:
    """Encode whole texts and write ``path/data``, then ``path/index``. ``tokenizer`` is a file that every executor has."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    # The row's place in the scan only spreads repeated rows over ranges; they are equal in all that is written.
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("place")]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(ranges or _ranges(docs.select(key, text)), *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch.column(1)):
                ids, counts = encode(data, bounds)
                value = frames(batch.column(0).slice(lo, hi - lo).to_pylist(), np.insert(ids, np.cumsum(counts), end_id), counts + 1)
                yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])

    separator = empty_record().decode("latin-1")
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", separator).option(
        "encoding", "ISO-8859-1").text(f"{path}/data")
    read_frames(docs.sparkSession, path).write.parquet(f"{path}/index")


def _records(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and payload lengths of all records but empty ones."""
    at, found = 0, []
    length = struct.Struct("<Q").unpack_from
    while at < len(content):
        size = length(content, at)[0] if at + HEAD + TAIL <= len(content) else -1
        if size < 0 or at + HEAD + size + TAIL > len(content):
            raise ValueError(f"the file ends inside the record at {at}")
        if size:
            found.append((at, size))
        at += HEAD + size + TAIL
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _verify(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
    """Fail if a record's bytes have other checksums than they were written with."""
    def same(start, end, where):
        kept = np.stack([data[where + i] for i in range(4)], axis=1).copy().view("<u4")[:, 0]
        bad = np.flatnonzero(masked_crcs(data, start, end) != kept)
        if len(bad):
            raise ValueError(f"checksum of the record at {at[bad[0]]} does not match")

    lo = 0
    reach = np.cumsum(size)
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + CHECKED_BYTES, "right")))
        a, s = at[lo:hi], size[lo:hi]
        same(a, a + 8, a + 8)
        same(a + HEAD, a + HEAD + s, a + HEAD + s)
        lo = hi


def payload(content: bytes, at: int, size: int) -> tuple[int | None, np.ndarray]:
    """Document and token ids of the record at ``at``."""
    key, wide, flags = struct.unpack_from("<qHH", content, at + HEAD)
    ids = np.frombuffer(content, f"<u{wide}", (size - FACTS) // wide, at + HEAD + FACTS)
    return None if flags & 1 else key, ids


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, content)``; the number of a file is that of the range it holds."""
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("bigint").alias("file")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select(number, "content")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The index, made of all files under ``path/data``; every length and checksum is verified."""
    names = [f.split()[0] for f in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = content.as_py()
                at, size = _records(content)
                _verify(np.frombuffer(content, np.uint8), at, size)
                keys, counts, crcs = [], [], []
                for a, s in zip(at.tolist(), size.tolist()):
                    key, ids = payload(content, a, s)
                    keys.append(key)
                    counts.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                counts = np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), number)), pa.array(at), pa.array(size + HEAD + TAIL), pa.array(keys, pa.int64()),
                    pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(crcs, pa.int64())], names)

    return _files(spark, path).mapInArrow(run, INDEX)


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def positions(entries: DataFrame) -> DataFrame:
    """Index rows with ``start`` counted over all files; one row a file goes through the running sum."""
    totals = entries.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return entries.join(bases, "file").withColumn("start", F.col("start") + F.col("base")).drop("base")


def fetch(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """``(doc_id, file, at, ids)`` of the records that index rows name, read by their offsets; a file is opened once."""
    plan = entries.groupBy("file").agg(F.collect_list(F.struct("at", "bytes")).alias("plan"))  # no longer than a file's index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                content = content.as_py()
                at, size = (np.array([w[k] for w in wanted], np.int64) for k in ("at", "bytes"))
                _verify(np.frombuffer(content, np.uint8), at, size - HEAD - TAIL)
                found = [payload(content, a, s - HEAD - TAIL) for a, s in zip(at.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for k, _ in found], pa.int64()), pa.array([number] * len(found), pa.int64()), pa.array(at),
                    pa.array([i.astype(np.int64) for _, i in found], pa.list_(pa.int64()))], ["doc_id", "file", "at", "ids"])

    return _files(spark, path).join(plan, "file").select("file", "content", "plan").mapInArrow(run, "doc_id bigint, file bigint, at bigint, ids array<bigint>")


def shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in an order that ``seed`` decides: offsets are permuted, then records are fetched and sorted by their place."""
    place = F.xxhash64(F.lit(seed), "file", "at")
    return fetch(spark, path, index(spark, path)).withColumn("place", place).orderBy("place", "file", "at").drop("place")


def round_trip(docs: DataFrame, path: str, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write, read back, and give each record its place among all ids: ``doc_id, start, n_tokens, ids_crc32``."""
    write(docs, path, tokenizer, end_id, **options)
    return positions(index(docs.sparkSession, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
