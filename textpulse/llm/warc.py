r"""WARC archives: write captures, resolve revisits by payload digest, read archives back.

A record is one row of Spark's text sink, whose line separator is the two line breaks that end a WARC record, so the files
are written by Spark's commit protocol to any file system it knows; gzip compresses them on the way. Reading takes whole
files (``rows_per_file`` bounds them) and cuts records by their Content-Length, never by searching for separators.

Only headers decide: payload digest and length are computed where the page is, groups of equal payloads are found by a
combined aggregate over (digest, length), and only groups with two or more members are joined back. Payloads of fewer than
``MIN_BYTES`` are always stored.

Defined results: a null payload is empty; of equal payloads the record with the largest id is the response, and if several
rows share that id all of them are; records without an id revisit the largest id of their group, or are responses if the
group has none; line breaks and spaces of a URI are percent-encoded; columns other than id, uri and payload are not archived.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 1000
ROWS_PER_FILE = 20_000
BREAK = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("record_type string, record_id string, target_uri string, page_id bigint, date string, content_length bigint, "
          "header_digest string, body_digest string, refers_to_id string, refers_to bigint")


def headers(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """One capture per row: ``page_id, target_uri, payload, payload_bytes, payload_digest``."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(uri).alias("target_uri"), body.alias("payload")).withColumns({
        "payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1("payload")})


def resolve(captures: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds ``record_type`` and ``refers_to``, the id of the response that a revisit repeats."""
    groups = captures.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.count("*").alias("n"), F.max("page_id").alias("original"))
    shared = groups.where("n > 1 AND original IS NOT NULL").select("payload_digest", "payload_bytes", "original")
    out = captures.join(shared, ["payload_digest", "payload_bytes"], "left")
    repeats = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return out.withColumns({"record_type": F.when(repeats, "revisit").otherwise("response"),
                            "refers_to": F.when(repeats, F.col("original"))}).drop("original")


def _urn(key: Column, digest: Column) -> Column:
    """A record id that a retried task writes again, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record(written: Column) -> Column:
    """A whole record: fresh headers, and the payload unless it is a revisit."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))

    revisit = F.col("record_type") == "revisit"
    uri = F.replace(F.replace(F.replace(F.coalesce("target_uri", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
                    F.lit(" "), F.lit("%20"))
    common = [
        F.lit("WARC/1.1" + BREAK), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("page_id"), F.col("payload_digest"))), line("WARC-Target-URI", uri),
        line("WARC-Date", written), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit("")))]
    refers = [line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("refers_to"), F.col("payload_digest"))),
              line("X-Refers-To-Page", F.col("refers_to").cast("string")), F.lit(f"Content-Length: 0{BREAK}{BREAK}")]
    stored = [F.lit("Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK * 2), F.col("payload")]
    return F.when(revisit, F.concat(*common, *refers)).otherwise(F.concat(*common, *stored))


def write(resolved: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, date: str | None = None) -> None:
    """Write archives to ``path``. ``date`` is the WARC-Date, by default the time of the query."""
    written = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    resolved.select(record(written).alias("value")).write.option("lineSep", BREAK * 2).option("compression", "gzip").option(
        "maxRecordsPerFile", rows_per_file).text(path)


def parse(content: bytes, piece: int = 1 << 20) -> Iterator[tuple]:
    """Records of one archive, gzip or plain; holds one header and one piece of a payload at a time."""
    unzip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
    buffer, at, end = bytearray(), 0, len(content)

    def more() -> bool:
        nonlocal at, unzip
        if unzip is not None and unzip.eof:  # the next member of the file
            content_left = unzip.unused_data
            if not content_left and at >= end:
                return False
            unzip = zlib.decompressobj(31)
            buffer.extend(unzip.decompress(content_left))
            return True
        if at >= end:
            return False
        part = content[at:at + piece]
        at += len(part)
        buffer.extend(unzip.decompress(part) if unzip else part)
        return True

    while True:
        while (cut := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        fields: dict[str, str] = {}
        for line in bytes(buffer[:cut]).decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        del buffer[:cut + 4]
        left = length = int(fields["content-length"])
        digest = hashlib.sha1()
        while left:
            if not buffer and not more():
                raise ValueError("archive ends inside a record")
            part = buffer[:left]
            digest.update(part)
            left -= len(part)
            del buffer[:len(part)]
        while len(buffer) < 4 and more():
            pass
        del buffer[:4]
        number = [int(v) if (v := fields.get(k)) else None for k in ("x-page-id", "x-refers-to-page")]
        yield (fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), number[0], fields.get("warc-date"),
               length, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, digest.hexdigest(),
               fields.get("warc-refers-to"), number[1])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``; ``body_digest`` is computed from the bytes read."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64() if " bigint" in f else pa.string() for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = list(parse(content.as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def originals(records: DataFrame) -> DataFrame:
    """Adds ``payload_bytes`` and ``payload_digest`` of the full payload: a revisit takes them from the response it names.

    A response whose bytes do not have the digest of its header fails the query.
    """
    whole = records.where("record_type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("content_length").alias("_bytes"), F.col("body_digest").alias("_digest")).distinct()
    revisits = records.where("record_type = 'revisit'").join(whole, F.col("refers_to_id") == F.col("_id"), "left")
    checked = F.when(F.col("body_digest") == F.col("header_digest"), F.col("body_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.coalesce("record_id", F.lit("")))))
    return records.where("record_type <> 'revisit'").withColumns({
        "payload_bytes": F.col("content_length"), "payload_digest": checked}).unionByName(
        revisits.withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_digest")}).drop("_id", "_bytes", "_digest"))
