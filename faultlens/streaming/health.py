"""Health of sources as running state: consecutive errors, an open circuit with doubling cooldown, late runs apart.

Runs may come in any order up to the watermark: what is newer waits in state, is folded into the settled part in order of
time when the watermark has passed it (by timers), and a row of the present health counts both. A run that comes twice is
one. Runs behind the watermark change nothing; `late_runs` says how many there were. State per source: four values
and the runs within the watermark's delay.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OPEN_AFTER, BASE_MINUTES, MOST_MINUTES = 3, 30, 480
_RESULT = "source string, last_success long, last_error long, consecutive_errors int, backoff_minutes int, cooldown_until long, retry_allowed boolean, seq long"


def backoff(errors: int) -> int:
    """Minutes to wait after so many errors in a row."""
    return min(MOST_MINUTES, BASE_MINUTES << min(errors - OPEN_AFTER, 20)) if errors >= OPEN_AFTER else 0


class _Health(StatefulProcessor):
    """Times are microseconds. What waits is a list: a batch is appended in one call, read in one, and written anew when the
    watermark has passed some of it. One timer stands for the earliest run that waits, one for the end of a cooldown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "errors int, last_success long, last_error long, seq long")
        self.waiting = handle.getListState("waiting", "at long, tie long, bad boolean")

    def _state(self) -> tuple:
        return tuple(self.settled.get()) if self.settled.exists() else (0, None, None, 0)

    @staticmethod
    def _after(state: tuple, at: int, bad: bool) -> tuple:
        errors, success, error, seq = state
        return (errors + 1, success, at, seq) if bad else (0, at, error, seq)

    @staticmethod
    def _in_order(runs: list[tuple]) -> list[tuple]:
        """A run that came twice is one, as it came last."""
        return sorted((*k, bad) for k, bad in {(at, tie): bad for at, tie, bad in runs}.items())

    def _present(self, source: str, watermark: int, settled: tuple, waiting: list[tuple]) -> Row:
        seq = settled[3] + 1
        self.settled.update((*settled[:3], seq))
        state = settled
        for at, _, bad in waiting:
            state = self._after(state, at, bad)
        errors, success, error, _ = state
        minutes = backoff(errors)
        until = error + minutes * 60_000_000 if minutes else None
        for moment in {waiting[0][0] if waiting else None, until if until is not None and until > watermark else None} - {None}:
            self.handle.registerTimer(moment // 1000 + 1)
        return Row(source=source, last_success=success, last_error=error, consecutive_errors=errors, backoff_minutes=minutes, cooldown_until=until, retry_allowed=until is None or until <= watermark, seq=seq)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at"], r["tie"], r["bad"]) for r in rows]
        before = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.appendList(new)
        yield self._present(key[0], timerValues.getCurrentWatermarkInMs() * 1000, self._state(), self._in_order(before + new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        runs = self._in_order([tuple(r) for r in self.waiting.get()]) if self.waiting.exists() else []
        n = bisect_right(runs, watermark, key=lambda r: r[0])
        state = self._state()
        for at, _, bad in runs[:n]:
            state = self._after(state, at, bad)
        if n and runs[n:]:
            self.waiting.put(runs[n:])
        elif n:
            self.waiting.clear()
        yield self._present(key[0], watermark, state, runs[n:])

    def close(self) -> None:
        pass


def health_changes(runs: DataFrame, source: str, bad: Column, at: str, tie: str, delay: str) -> DataFrame:
    """A stream of runs -> rows of health, numbered by seq for each source; the last one holds."""
    marked = runs.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    rows = marked.select("_at", F.col(source).cast("string").alias("source"), F.unix_micros("_at").alias("at"), F.col(tie).cast("long").alias("tie"), bad.alias("bad"))
    return rows.groupBy("source").transformWithState(_Health(), _RESULT, "Update", "EventTime")


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state with timers needs this store."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(changes: DataFrame, folder: str) -> StreamingQuery:
    """Works through what there is and writes each batch's rows to a folder of its own, so that one that is repeated after
    a failure replaces itself. A later call goes on from the checkpoint."""

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    with _state_store(changes.sparkSession):
        query = changes.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def present(spark: SparkSession, folder: str) -> DataFrame:
    """source, last_success, last_error, consecutive_errors, circuit_open, backoff_minutes, cooldown_until,
    retry_allowed: the newest row of each source."""
    rows = spark.read.parquet(f"{folder}/rows")
    last = rows.groupBy("source").agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")
    times = {c: F.timestamp_micros(c) for c in ("last_success", "last_error", "cooldown_until")}
    return last.withColumns(times).withColumn("circuit_open", F.col("consecutive_errors") >= OPEN_AFTER).drop("batch", "seq")


def late_runs(query: StreamingQuery) -> int:
    """Runs that a call of `keep` left out, because they lay behind the watermark."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
