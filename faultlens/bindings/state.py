"""State that is kept between runs: health of sources over a stream, a read-through cache."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

import faultlens.bindings.quality  # noqa: F401  (its SQL is used below)
from faultlens.bindings.registry import ORACLE, query
from faultlens.operators import quality
from faultlens.session import shared_folder
from faultlens.session import table as t
from faultlens.streaming import cache, health
from faultlens.streaming.events import event_stream


def _place(s, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid4().hex[:12]}"


@query("t01_health_stream", ORACLE["x61_ingest_health"])
def _(s, d):
    """All events, dealt over files without order, in two calls with a restart between."""
    files, folder = _place(s, "shuffled-events"), _place(s, "health")
    events = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4, "event_id").write.parquet(files)
    bad = F.col("event_type") == "error"
    for per_trigger in (2, 4):
        stream = event_stream(s, files, events.schema, per_trigger)
        health.keep(health.health_changes(stream, "user_id", bad, "ts", "event_id", "60 days"), folder)
    return quality.health_status(
        health.present(s, folder).select(F.col("source").cast("long").alias("user_id"), F.col("last_success").cast("timestamp_ntz").alias("last_success"), "consecutive_errors", "circuit_open", "backoff_minutes"),
        F.lit("2024-02-26").cast("timestamp_ntz"),
    ).withColumn("consecutive_errors", F.col("consecutive_errors").cast("long"))


@query("t05_cache_runs", """WITH r AS (SELECT role || ':' || CAST(length(text) % 97 AS VARCHAR) AS key, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS run FROM conversations WHERE text IS NOT NULL
  UNION ALL SELECT role || ':' || CAST(length(text) % 97 AS VARCHAR), 2 FROM conversations WHERE role = 'user' AND text IS NOT NULL),
 k AS (SELECT key, ends_with(key, '3') AS fails, min(run) AS first FROM r GROUP BY 1)
 SELECT key, count(*) FILTER (NOT fails AND run > first) AS hits, count(*) FILTER (fails OR run = first) AS misses, CASE WHEN any_value(fails) THEN 0 ELSE 1 END AS puts FROM r JOIN k USING (key) GROUP BY 1""")
def _(s, d):
    """Two runs: users' turns, then all turns. Fetches of keys that end in 3 fail each time."""
    kept = cache.Cache(s, _place(s, "cache"))
    turns = t(s, d, "conversations").where("text is not null").select("role", F.concat_ws(":", "role", F.length("text") % 97).alias("key"))
    fetch = cache.fetcher(lambda key: None if key.endswith("3") else key.upper())
    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    kept.serve(1, turns.where("role = 'user'"), at(1), "5 days", fetch)
    kept.serve(2, turns, at(2), "5 days", fetch)
    return kept.counts()
