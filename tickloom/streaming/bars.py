"""Bars and sessions from a stream, with the same results as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hour bars by event type; works on a stream and on a table."""
    rows = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), "value", "event_id").where("value > 0")
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    order = F.struct("at", "event_id")
    out = rows.groupBy("symbol", F.window("at", "1 hour").alias("w")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Activity sessions of users."""
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("at"), "value")
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("last_ts"), "n", "total")
