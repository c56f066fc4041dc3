"""A read-through cache as an append log: answers with a lifetime, one fetch for each different key that is missing.

A batch of requests is a transaction with an id: its log entries (a put for each fetched answer, counts of hits and of
misses for each key) are one folder, written last, and a batch that is asked for again is read from it. A fetch that fails leaves no
answer, so the next request fetches again. `compact` writes the live answers and the counts so far as one entry and
drops what it replaces. Requests of one batch that miss the same key count as misses and share its fetch.

A key that is null is answered with null and never fetched. Hot keys: requests are counted by key before they meet
the answers, and get them back by a join on the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators.ranking import first_of

_LOG = "key string, value string, at timestamp, expires timestamp, hits long, misses long, puts long"


class Cache:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _complete(self) -> dict[int, str]:
        """Entries by batch: those from the newest compacted one on."""
        if not self.fs.exists(self._path("log")):
            return {}
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("log"))]
        done = {int(n.split("-")[1]): n for n in sorted(names, reverse=True) if self.fs.exists(self._path(f"log/{n}/_SUCCESS"))}
        base = max((b for b, n in done.items() if n.startswith("all")), default=None)
        return done if base is None else {b: n for b, n in done.items() if b >= base}

    def _log(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(*[f"{self.folder}/log/{n}" for n in names]) if names else self.spark.createDataFrame([], _LOG)

    def answers(self, now: Column) -> DataFrame:
        """key, value, expires: the newest put of each key that has not run out."""
        puts = self._log(list(self._complete().values())).where(F.col("puts") > 0).where("at is not null")
        return first_of(puts, ["key"], [F.desc("at")]).where(F.col("expires") > now).select("key", "value", "expires")

    def counts(self) -> DataFrame:
        """key, hits, misses, puts so far."""
        return self._log(list(self._complete().values())).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "puts")])

    def serve(self, batch: int, requests: DataFrame, now: Column, lifetime: str, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """requests (with a column key) and their values. fetch: rows of different keys -> key, value (rows that it
        leaves out, or gives a null, have failed)."""
        done = self._complete()
        if done and batch <= max(done):
            if batch not in done or done[batch].startswith("all"):
                raise ValueError(f"batch {batch} is compacted already")
        else:
            known = self.answers(now)
            asked = requests.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(known, "key", "left")
            place = f"{self.folder}/asked/{batch}"  # fetched once: what follows reads it from here
            missing = fetch(asked.where("expires is null").select("key")).where("value is not null").select("key", F.col("value").alias("fetched"))
            asked.join(missing, "key", "left").write.mode("overwrite").parquet(place)
            rows, hit = self.spark.read.parquet(place), F.col("expires").isNotNull()
            put = F.col("fetched").isNotNull()
            entries = rows.select(
                "key", F.when(put, F.col("fetched")).alias("value"), F.when(put, now).alias("at"), F.when(put, now + F.expr(f"interval {lifetime}")).alias("expires"),
                F.when(hit, F.col("n")).otherwise(0).alias("hits"), F.when(hit, 0).otherwise(F.col("n")).alias("misses"), put.cast("long").alias("puts"),
            )
            entries.withColumns({"at": F.col("at").cast("timestamp"), "expires": F.col("expires").cast("timestamp")}).write.mode("overwrite").parquet(f"{self.folder}/log/one-{batch}")
        found = self.spark.read.parquet(f"{self.folder}/asked/{batch}").select("key", F.coalesce("value", "fetched").alias("value"))
        return requests.join(found, "key", "left")

    def compact(self, now: Column) -> None:
        """The log so far as one entry: live answers, and the counts of all keys."""
        done = self._complete()
        if not done:
            return
        last = max(done)
        rows = self.counts().join(self.answers(now).withColumn("at", now.cast("timestamp")), "key", "left")
        rows.select("key", "value", "at", "expires", "hits", "misses", "puts").write.mode("overwrite").parquet(f"{self.folder}/log/all-{last}")
        for name in done.values():
            if name != f"all-{last}":
                self.fs.delete(self._path(f"log/{name}"), True)


def fetcher(call: Callable[[str], str | None]) -> Callable[[DataFrame], DataFrame]:
    """fetch for `Cache.serve` from a function of one key, called where the keys are; an exception is a failed fetch."""
    import pandas as pd

    def one(key: str) -> str | None:
        try:
            return call(key)
        except Exception:
            return None

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "value": [one(k) for k in frame["key"]]})

    return lambda missing: missing.mapInPandas(run, "key string, value string")
