"""The call graph of code, stored as adjacency: who calls whom, looked up in both directions by equality.

Built once from a table of code (file, symbol, text): every name before a parenthesis in a symbol's text is a call,
keywords and the symbol itself aside. It is stored twice, in files sorted by caller and by called name, so that a lookup reads
the row groups of its names and no code. A lookup takes a table of requests. Where the graph's health says that it is
down or stale, lookups go to the code itself and say so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.symbols import KEYWORDS
from faultlens.operators.ranking import top_n

CALL = r"\b([A-Za-z_]\w*)\s*\("


def calls(code: DataFrame) -> DataFrame:
    """file, caller, called, times."""
    names = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(CALL), F.lit(1)), lambda x: ~x.isin([*KEYWORDS, "sizeof"]))
    each = code.select("file", F.col("symbol").alias("caller"), F.explode(names).alias("called")).where(F.col("called") != F.col("caller"))
    return each.groupBy("file", "caller", "called").agg(F.count(F.lit(1)).alias("times"))


class CallGraph:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.by = {side: spark.read.parquet(f"{folder}/by_{side}") for side in ("caller", "called")}

    @classmethod
    def write(cls, code: DataFrame, folder: str) -> CallGraph:
        made = calls(code)
        for side, other in (("caller", "called"), ("called", "caller")):
            made.repartitionByRange(side, other).sortWithinPartitions(side, other).write.mode("overwrite").parquet(f"{folder}/by_{side}")
        return cls(code.sparkSession, folder)

    def look_up(self, requests: DataFrame, direction: str, limit: int = 50) -> DataFrame:
        """symbol -> symbol, place, other, file, times: its callers or callees, by name and file, `limit` a symbol."""
        own, other = {"callers": ("called", "caller"), "callees": ("caller", "called")}[direction]
        return _looked_up(self.by[own], requests, own, other, limit)


def _looked_up(graph: DataFrame, requests: DataFrame, own: str, other: str, limit: int) -> DataFrame:
    asked = requests.select(F.trim("symbol").alias("symbol")).where("symbol <> ''").distinct()
    hit = asked.join(graph.select(F.col(own).alias("symbol"), F.col(other).alias("other"), "file", "times"), "symbol")
    return top_n(hit, ["symbol"], [F.col("other"), F.col("file")], limit).select("symbol", F.col("rn").alias("place"), "other", "file", "times")


def look_up(requests: DataFrame, graph: CallGraph | None, code: DataFrame, health: DataFrame, direction: str, limit: int = 50) -> DataFrame:
    """CallGraph.look_up with a column degraded: where health (one row: healthy) is not true, or there is no graph, the code is
    read instead. Only the way that is taken is run."""
    ok = graph is not None and bool((health.first() or [False])[0])
    own, other = {"callers": ("called", "caller"), "callees": ("caller", "called")}[direction]
    found = graph.look_up(requests, direction, limit) if ok else _looked_up(calls(code), requests, own, other, limit)
    return found.withColumn("degraded", F.lit(not ok))
