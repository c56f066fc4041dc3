"""Running health with late runs and timers; the cache's lifetimes, failures, repeated batches and compaction."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultlens.streaming import cache, health
from faultlens.streaming.events import event_stream

T0 = datetime(2024, 1, 1)
SCHEMA = "source string, ts timestamp, id long, bad boolean"


def write(spark, folder, name, rows):
    data = [(s, T0 + timedelta(minutes=m), i, b) for s, m, i, b in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_health_settles_cools_down_and_counts_late_runs(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        files, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"

        def step(name, rows):
            write(spark, files, name, rows)
            stream = event_stream(spark, f"{files}/*", spark.createDataFrame([], SCHEMA).schema)
            query = health.keep(health.health_changes(stream, "source", F.col("bad"), "ts", "id", "30 minutes"), out)
            return query, {r["source"]: r for r in health.present(spark, out).collect()}

        _, got = step("a", [("x", 20, 3, True), ("x", 0, 1, False), ("x", 10, 2, True), ("y", 5, 4, False), ("x", 30, 5, True), ("x", 30, 5, True)])
        assert (got["x"]["consecutive_errors"], got["x"]["circuit_open"], got["x"]["backoff_minutes"]) == (3, True, 30)
        assert got["x"]["cooldown_until"] == T0 + timedelta(minutes=60) and not got["x"]["retry_allowed"] and not got["y"]["circuit_open"]
        _, got = step("b", [("x", 25, 6, False)])  # before the last error, within the delay: only one error is left
        assert (got["x"]["consecutive_errors"], got["x"]["last_success"]) == (1, T0 + timedelta(minutes=25))
        _, got = step("c", [("x", 31, 7, True), ("x", 32, 8, True), ("x", 33, 9, True), ("y", 200, 10, True)])
        assert (got["x"]["consecutive_errors"], got["x"]["backoff_minutes"]) == (4, 60)
        assert got["x"]["retry_allowed"]  # the watermark (170) has passed the cooldown (93), told by a timer
        query, got = step("d", [("x", 40, 11, False), ("y", 201, 12, True)])
        assert health.late_runs(query) == 1 and got["x"]["consecutive_errors"] == 4 and got["y"]["consecutive_errors"] == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_backoff_doubles_to_a_limit():
    assert [health.backoff(n) for n in (0, 2, 3, 4, 5, 7, 8, 60)] == [0, 0, 30, 60, 120, 480, 480, 480]


def test_cache(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def call(key):
        (calls / f"{key}-{len(list(calls.iterdir()))}").touch()
        if key == "bad":
            raise OSError(key)
        return None if key == "none" else f"v-{key}"

    kept = cache.Cache(spark, f"file://{tmp_path}/cache")
    at = lambda day: F.lit(f"2024-01-{day:02d}").cast("timestamp")
    fetch = cache.fetcher(call)
    serve = lambda batch, day, keys: sorted(((r["key"], r["value"]) for r in kept.serve(batch, spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1), at(day), "3 days", fetch).collect()), key=str)
    assert kept.counts().collect() == []
    first = [("a", "v-a"), ("a", "v-a"), ("b", "v-b"), ("bad", None), (None, None), ("none", None)]
    assert serve(1, 1, ["a", "a", "b", "bad", None, "none"]) == sorted(first, key=str)
    n = len(list(calls.iterdir()))
    assert n == 4  # one for each different key
    assert serve(1, 1, ["a", "a", "b", "bad", None, "none"]) == sorted(first, key=str) and len(list(calls.iterdir())) == n  # again: nothing new
    assert serve(2, 2, ["a", "c", "bad"]) == [("a", "v-a"), ("bad", None), ("c", "v-c")]
    want = {("a", 1, 2, 1), ("b", 0, 1, 1), ("c", 0, 1, 1), ("bad", 0, 2, 0), ("none", 0, 1, 0)}
    assert {tuple(r) for r in kept.counts().collect()} == want
    kept.compact(at(2))
    assert {tuple(r) for r in kept.counts().collect()} == want and len(list((tmp_path / "cache" / "log").iterdir())) == 1
    assert {r["key"] for r in kept.answers(at(3)).collect()} == {"a", "b", "c"}
    assert {r["key"] for r in kept.answers(at(4)).collect()} == {"c"}  # a and b ran out
    with pytest.raises(ValueError, match="compacted"):
        serve(2, 2, ["a"])
    assert serve(3, 4, ["a", "c"]) == [("a", "v-a"), ("c", "v-c")]
    assert {tuple(r) for r in kept.counts().where("key in ('a', 'c')").collect()} == {("a", 1, 3, 2), ("c", 1, 1, 1)}
