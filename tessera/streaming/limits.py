"""Structured Streaming over events: the rate limiter, windowed counts under a watermark, and runs over what a source holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.streaming import folds


def rate_limited(events: DataFrame, limit: int, window_s: int) -> DataFrame:
    """events: (user_id, event_id, ts), a stream. (user_id, event_id, allowed, remaining): a hit is allowed while fewer than `limit` allowed ones lie in the last window_s seconds."""
    rows = events.select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("hit").alias("kind"), F.col("event_id").cast("string").alias("member"))
    fold, result = folds.limiter([(limit, window_s)])
    found = folds.stream(rows, fold, result, window_s)
    return found.select(F.col("key").cast("bigint").alias("user_id"), "event_id", "allowed", "remaining")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type and window; rows later than the watermark are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source holds now and returns what it wrote, from a memory table: for tests and bounded replays."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
