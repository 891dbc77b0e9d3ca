"""Latency, token and cost accounting of operations (op_id, metric_name, latency_ms, prompt_tokens, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def measured(ops: DataFrame) -> DataFrame:
    """With latency_ms from the timestamps, tokens from characters where they weren't counted, and cost."""
    has = set(ops.columns)
    if "latency_ms" not in has:
        ops = ops.withColumn("latency_ms", (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1000.0)
    for side in ("prompt", "completion"):
        chars = text.tokens_of_chars(f"{side}_chars") if f"{side}_chars" in has else F.lit(0)
        ops = ops.withColumn(f"{side}_tokens", F.coalesce(F.col(f"{side}_tokens"), chars) if f"{side}_tokens" in has else chars)
    return ops.withColumn("cost_usd", text.cost("model" if "model" in has else F.lit(""), "prompt_tokens", "completion_tokens"))


def by_metric(ops: DataFrame) -> DataFrame:
    """Count, latency, tokens and cost for each metric and, in the row with a null name, in total."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    return ops.rollup("metric_name").agg(
        F.count("*").alias("n_ops"),
        F.round(F.sum("latency_ms"), 2).alias("total_ms"),
        F.round(F.avg("latency_ms"), 2).alias("avg_ms"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
        F.sum(tokens).cast("long").alias("tokens"),
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
    )


def op_id(query: str = "query_id", k: str = "k", metric: str = "metric_name"):
    return F.concat(F.col(query).cast("string"), F.lit("@"), F.col(k).cast("string"), F.lit("_"), F.col(metric))
