"""Structured Streaming: windowed counts with late data, and health kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and group; rows more than `late` behind the newest are dropped. Works on batches too."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark(time, late) if stamped.isStreaming else stamped
    return stamped.groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def session_counts(events: DataFrame, time: str, by: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark(time, late) if stamped.isStreaming else stamped
    return stamped.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("finish"), by, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works through what is there, then stops; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
