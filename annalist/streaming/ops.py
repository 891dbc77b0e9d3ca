"""Operation statistics over event time, for streams and for tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, lateness: str | None) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", lateness) if lateness else e


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, lateness: str | None = "1 hour") -> DataFrame:
    """Count and latency of each metric in tumbling or sliding windows; events later than lateness are
    dropped from streams."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = _timed(events, lateness).groupBy(w, "metric_name").agg(F.count("*").alias("n_ops"), F.sum("latency_ms").alias("sum_ms"), F.max("latency_ms").alias("max_ms"))
    return g.select(F.col("window.start").alias("window_start"), "metric_name", "n_ops", "sum_ms", "max_ms")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", lateness: str | None = "1 hour") -> DataFrame:
    g = _timed(events, lateness).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n_ops"), F.sum("latency_ms").alias("sum_ms"))
    return g.select(key, F.col("s.start").alias("session_start"), "n_ops", "sum_ms")


def distinct_ops(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each operation once, by op_id, within the watermark."""
    return _timed(events, lateness).dropDuplicatesWithinWatermark(["op_id"]) if events.isStreaming else events.dropDuplicates(["op_id"])


def upsert_scores(path: str):
    """For foreachBatch: each batch's scores in a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
