"""Threads that are kept up as mail arrives, in any order, with counts and dates.

A thread is a component of messages and the messages they answer or refer to, also such as have not come yet: a late
parent, or a message that refers to two threads, joins them. A thread is named by its smallest message id, so the order of
arrival makes no difference. Every batch is one entry of a log: new nodes with the thread they came to, threads that
became part of another, messages, and counts and dates by thread. Nothing is rewritten; a batch that is delivered again
replaces itself or is known already, and a message that comes twice counts once. Work of a batch: joins of its ids with the log,
and components of the threads it touches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators.graph import thread_roots
from faultlens.session import checkpointed

_LOG = "kind string, node string, thread string, n long, first timestamp, last timestamp"


def joined(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each node's component in edges (u, v). Each round hangs every root that has a
    smaller neighbour below the smallest one, then halves the paths."""
    f = checkpointed(edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct().withColumn("root", F.col("node")))
    for _ in range(most_rounds):
        of = lambda c, n: f.select(F.col("node").alias(c), F.col("root").alias(n))
        apart = edges.join(of("u", "a"), "u").join(of("v", "b"), "v").where("a <> b")
        hooks = apart.groupBy(F.greatest("a", "b").alias("root")).agg(F.min(F.least("a", "b")).alias("below"))
        hung = checkpointed(f.join(hooks, "root", "left").select("node", F.coalesce("below", "root").alias("root"), F.col("below").isNotNull().alias("moved")))
        if hung.where("moved").isEmpty():
            return f
        f = checkpointed(thread_roots(hung.select("node", F.when(F.col("node") != F.col("root"), F.col("root")).alias("up")), "node", "up"))
    raise RuntimeError("components did not settle")


class Threads:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _batches(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]

    def _log(self) -> DataFrame:
        done = self._batches()
        return self.spark.read.schema(_LOG).parquet(*[f"{self.folder}/{n}" for n in done]) if done else self.spark.createDataFrame([], _LOG)

    def _current(self, log: DataFrame) -> DataFrame:
        """thread, now: what became of threads that are part of another."""
        merged = log.where("kind = 'joined'").select("node", F.col("thread").alias("up"))
        ends = merged.select("node", "up").unionByName(merged.select(F.col("up").alias("node"), F.lit(None).cast("string").alias("up")).join(merged.select("node"), "node", "left_anti").distinct())
        return thread_roots(ends, "node", "up").select(F.col("node").alias("thread"), F.col("root").alias("now"))

    def add(self, batch: int, messages: DataFrame) -> None:
        """messages: id, refs (array of the ids it answers or refers to), date. Rows without an id are left out."""
        if f"batch-{batch}" in self._batches():
            return
        log, now = self._log(), None
        fresh = messages.where("id is not null").dropDuplicates(["id"]).join(log.where("kind = 'message'").select(F.col("node").alias("id")), "id", "left_anti")
        fresh = checkpointed(fresh.select("id", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), F.col("date").cast("timestamp").alias("date")))
        links = fresh.select(F.col("id").alias("u"), F.explode(F.concat(F.array("id"), F.filter("refs", lambda x: x.isNotNull()))).alias("v")).distinct()
        known = log.where("kind = 'node'").select("node", "thread")
        now = self._current(log)
        touched = links.select(F.col("v").alias("node")).distinct().join(known, "node", "left").join(now, "thread", "left")
        touched = checkpointed(touched.select("node", F.coalesce("now", "thread", "node").alias("thread"), F.col("thread").isNull().alias("new")))
        of = lambda c, n: touched.select(F.col("node").alias(c), F.col("thread").alias(n))
        roots = joined(checkpointed(links.join(of("u", "a"), "u").join(of("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()))
        placed = checkpointed(touched.join(roots.select(F.col("node").alias("thread"), "root"), "thread"))
        none = [F.lit(None).cast("long").alias("n"), F.lit(None).cast("timestamp").alias("first"), F.lit(None).cast("timestamp").alias("last")]
        nodes = placed.where("new").select(F.lit("node").alias("kind"), "node", F.col("root").alias("thread"), *none)
        merged = placed.where("not new and thread <> root").select(F.lit("joined").alias("kind"), F.col("thread").alias("node"), F.col("root").alias("thread"), *none).distinct()
        counted = fresh.join(placed.select(F.col("node").alias("id"), "root"), "id").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
        sums = counted.select(F.lit("sum").alias("kind"), F.lit(None).cast("string").alias("node"), F.col("root").alias("thread"), "n", "first", "last")
        came = fresh.select(F.lit("message").alias("kind"), F.col("id").alias("node"), F.lit(None).cast("string").alias("thread"), *none)
        reduce(DataFrame.unionByName, [nodes, merged, sums, came]).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")

    def members(self) -> DataFrame:
        """id, thread of every message that came."""
        log = self._log()
        here = log.where("kind = 'message'").select("node")
        own = log.where("kind = 'node'").select("node", "thread").join(here, "node").join(self._current(log), "thread", "left")
        return own.select(F.col("node").alias("id"), F.coalesce("now", "thread").alias("thread"))

    def summary(self) -> DataFrame:
        """thread, message_count, date_start, date_end; messages without a date count, but date nothing."""
        log = self._log()
        sums = log.where("kind = 'sum'").select("thread", "n", "first", "last").join(self._current(log), "thread", "left")
        return sums.groupBy(F.coalesce("now", "thread").alias("thread")).agg(F.sum("n").alias("message_count"), F.min("first").alias("date_start"), F.max("last").alias("date_end"))
