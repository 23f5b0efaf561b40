"""Extensions for event streams: windows by event time, the same function for a stream and for a table.

On a stream the late bound is a watermark; sinks get each window when the watermark has passed it. ``run_once`` drives a
folder of files through a streaming query to its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late and events.isStreaming else rows


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Tumbling or sliding windows by type: count and sum."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = "1 hour") -> DataFrame:
    """Windows of a user's activity that a gap ends."""
    g = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def latest(states: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Last state of each key."""
    return states.groupBy(key).agg(F.max_by(value, order).alias(value))


def run_once(spark: SparkSession, folder: str, schema: str, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Read all Parquet files of a folder as a stream, write what ``plan`` gives, and return it."""
    stream = spark.readStream.schema(schema).parquet(folder)
    q = plan(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
