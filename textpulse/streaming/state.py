"""Keyed upsert on a state store (X1): the newest value of every field of a key, with expiry, as an append-only log of changes.

The state of a key is its merged row and the version of each field. It lives in the state store, whose checkpoint the query
restarts from; a batch touches the keys it brings and nothing else, and no table is rewritten. What changes is appended: a
row for each key that a batch changed, numbered by key. Readers take the last one of each key, by an aggregate that combines
before its shuffle.

Rows may come late, repeatedly, and in any order: a field keeps its newest value that is set, and a row that changes nothing
leaves no trace. With ``expire_after`` the stream needs a watermark, and rows later than that do not count: the state of a key ends when
the watermark is that far beyond the newest time of its rows, and the log gets a row that ends the key. Rows that come after that begin
the key anew, with numbers that follow from the watermark and so are higher than any before.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from textpulse.session import shared_dir

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGE, ENDED = "change", "ended"


class Newest(StatefulProcessor):
    """Merges the rows of a key, field by field, and emits the merged row if that changed it."""

    def __init__(self, keys: list[str], fields: list[T.StructField], version: list[T.StructField], time: str | None, expire_ms: int | None):
        self.keys, self.version, self.time, self.expire_ms = keys, [v.name for v in version], time, expire_ms
        self.fields = [f.name for f in fields]
        set_at = [T.StructField(f"at_{i}_{v.name}", v.dataType) for i, _ in enumerate(fields) for v in version]
        self.kept = T.StructType([*fields, *version, *set_at, T.StructField(CHANGE, T.LongType()), T.StructField("due", T.LongType())])

    def init(self, handle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.kept)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.kept.names
        mark = max(0, timerValues.getCurrentWatermarkInMs()) if self.expire_ms is not None else 0
        known = self.row.exists()
        now = self._held() if known else dict.fromkeys(names) | {CHANGE: mark << 20, "due": 0}
        changed, newest = not known, mark
        for r in ({n: _local(x) for n, x in r.asDict().items()} for r in rows):
            at = tuple(r[v] for v in self.version)
            for i, f in enumerate(self.fields):
                before = tuple(now[f"at_{i}_{v}"] for v in self.version)
                if r[f] is not None and (now[f] is None or _order(at) > _order(before)):
                    changed |= now[f] != r[f]
                    now[f] = r[f]
                    now |= {f"at_{i}_{v}": x for v, x in zip(self.version, at)}
            if _order(at) > _order(tuple(now[v] for v in self.version)):
                now |= dict(zip(self.version, at))
                changed = True
            if self.expire_ms is not None and r[self.time] is not None:
                newest = max(newest, int(r[self.time].timestamp() * 1000))
        if self.expire_ms is not None and newest + self.expire_ms > now["due"]:
            if now["due"]:
                self.handle.deleteTimer(now["due"])
            now["due"] = newest + self.expire_ms
            self.handle.registerTimer(now["due"])
        if changed:
            now[CHANGE] += 1
            yield self._out(key, now, False)
        self.row.update(tuple(now[n] for n in names))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.row.exists():
            now = self._held()
            self.row.clear()
            yield self._out(key, now | {CHANGE: now[CHANGE] + 1}, True)

    def _held(self) -> dict:
        return {n: _local(x) for n, x in zip(self.kept.names, self.row.get())}

    def _out(self, key, now: dict, ended: bool) -> Row:
        return Row(**dict(zip(self.keys, key)), **{f: now[f] for f in (*self.fields, *self.version)}, **{CHANGE: now[CHANGE], ENDED: ended})

    def close(self) -> None:
        pass


def _local(value):
    """Timestamps as Spark's rows have them, without a zone; the state gives them one."""
    return value.astimezone().replace(tzinfo=None) if isinstance(value, dt.datetime) and value.tzinfo else value


def _order(version: tuple) -> tuple:
    """Versions in comparable form; null is the oldest."""
    return tuple((False,) if v is None else (True, v) for v in version)


def state_upsert(stream: DataFrame, keys: list[str], version: list[str], target: str | None = None,
                 time: str | None = None, expire_after: dt.timedelta | None = None, delay: str = "0 seconds") -> str:
    """Run the stream over all available input, append changes to ``target/log``, and return ``target``.

    A second call with the same ``target`` goes on where the first ended, or was interrupted. ``time`` is the timestamp column of the
    watermark, needed for an expiry, and ``delay`` its delay.
    """
    spark = stream.sparkSession
    base = target or shared_dir(spark, "state-upsert")
    schema = stream.schema
    fields = [f for f in schema.fields if f.name not in keys and f.name not in version]
    out = T.StructType([*(schema[k] for k in keys), *fields, *(schema[v] for v in version), T.StructField(CHANGE, T.LongType()), T.StructField(ENDED, T.BooleanType())])
    expire_ms = int(expire_after.total_seconds() * 1000) if expire_after else None
    rows = stream if expire_ms is None else stream.withWatermark(time, delay)
    processor = Newest(keys, fields, [out[v] for v in version], time, expire_ms)
    changes = rows.groupBy(*keys).transformWithState(processor, out, "Append", "None" if expire_ms is None else "EventTime")
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        query = (changes.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/state")
                 .trigger(availableNow=True).start(f"{base}/log"))
        query.awaitTermination()
    finally:
        spark.conf.set(STORE[0], before)
    return base


def latest(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last change of each key that has not ended."""
    log = spark.read.parquet(f"{target}/log")
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), CHANGE).alias("_last")).where(f"NOT _last.{ENDED}")
    return last.select(*keys, *(F.col("_last")[c].alias(c) for c in rest if c not in (CHANGE, ENDED)))
