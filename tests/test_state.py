"""Keyed upsert on the state store: late, repeated and expired rows, and a restart in the middle."""

import datetime as dt
import glob

import pytest

from textpulse.streaming import state

SCHEMA = "user_id long, ts timestamp, event_id long, name string, v double"
VERSION = ["ts", "event_id"]


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture
def feed(spark, tmp_path):
    """Deliveries one after the other, and the stream over them."""
    number = iter(range(100))

    def deliver(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{next(number):02d}"))

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    return deliver, stream, str(tmp_path / "out")


def held(spark, target):
    return sorted(tuple(r) for r in state.latest(spark, target, ["user_id"]).select("user_id", "name", "v").collect())


def test_late_and_repeated_rows_and_a_restart(spark, feed):
    deliver, stream, target = feed
    deliver((7, at(20), 1, "new", None), (8, at(2), 2, "x", 2.0))
    deliver((7, at(1), 3, "old", 3.0), (9, at(1), 4, "late", 4.0))  # 7's value was not set by the newer row
    state.state_upsert(stream(), ["user_id"], VERSION, target)
    assert held(spark, target) == [(7, "new", 3.0), (8, "x", 2.0), (9, "late", 4.0)]
    files = set(glob.glob(f"{target}/log/*.parquet"))
    deliver((8, at(2), 2, "x", 2.0), (7, at(1), 3, "old", 3.0))  # delivered again: nothing changes
    deliver((8, at(2), 5, None, 5.0))
    state.state_upsert(stream(), ["user_id"], VERSION, target)
    assert held(spark, target) == [(7, "new", 3.0), (8, "x", 5.0), (9, "late", 4.0)]
    added = set(glob.glob(f"{target}/log/*.parquet")) - files
    assert files <= set(glob.glob(f"{target}/log/*.parquet"))  # nothing is rewritten
    assert sum(spark.read.parquet(f).count() for f in added) == 1  # one key changed


def test_expired_keys_end_and_may_begin_anew(spark, feed):
    deliver, stream, target = feed
    run = lambda: state.state_upsert(stream(), ["user_id"], VERSION, target, time="ts", expire_after=dt.timedelta(days=3))
    deliver((1, at(1), 1, "one", 1.0), (2, at(2), 2, "two", 2.0))
    deliver((2, at(10), 3, "again", None))
    deliver((3, at(10, 1), 4, "three", 3.0))
    run()
    assert held(spark, target) == [(2, "again", 2.0), (3, "three", 3.0)]  # 1 ended, 2 was renewed in time
    deliver((1, at(11), 5, "anew", None), (3, at(1), 6, "too late", 9.0))
    run()
    assert held(spark, target) == [(1, "anew", None), (2, "again", 2.0), (3, "three", 3.0)]
    log = spark.read.parquet(f"{target}/log").where("user_id = 1")
    assert [(r.name, r.ended) for r in log.orderBy("change").collect()] == [("one", False), ("one", True), ("anew", False)]


def test_a_batch_without_rows_and_rows_without_version(spark, feed):
    deliver, stream, target = feed
    deliver((1, None, None, "none", None), (1, at(1), None, None, 1.0))
    state.state_upsert(stream(), ["user_id"], VERSION, target)
    state.state_upsert(stream(), ["user_id"], VERSION, target)
    assert held(spark, target) == [(1, "none", 1.0)]
