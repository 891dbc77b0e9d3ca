"""Results in long form (run_id, query_id, metric, k, score): aggregation, export, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aggregate(scores: DataFrame, by: tuple[str, ...] = ("metric", "k")) -> DataFrame:
    """Mean and population standard deviation of each metric, without missing and NaN scores; metrics
    without any score are left out."""
    ok = scores.withColumn("score", F.nanvl("score", F.lit(None).cast("double"))).where("score IS NOT NULL")
    return ok.groupBy(*by).agg(F.round(F.avg("score"), 5).alias("mean"), F.round(F.stddev_pop("score"), 5).alias("std"), F.count("*").alias("n"))


def named(scores: DataFrame) -> DataFrame:
    """With metric@k as name where there is a k."""
    return scores.withColumn("name", F.when(F.col("k").isNull(), F.col("metric")).otherwise(F.concat_ws("@", "metric", F.col("k").cast("string"))))


def wide(scores: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row for each query and a column for each metric@k."""
    n = named(scores)
    return n.groupBy("query_id").pivot("name", names).agg(F.first("score"))


def lookup(scores: DataFrame, query_id, metric: str, k: int | None = None) -> DataFrame:
    found = scores.where((F.col("query_id") == query_id) & (F.col("metric") == metric))
    return found if k is None else found.where(F.col("k") == k)


def summary(scores: DataFrame) -> str:
    """Lines of mean +/- std, sorted by metric: as many as there are metrics."""
    rows = aggregate(named(scores), ("name",)).orderBy("name").collect()
    return "\n".join(f"{r['name']}: {r['mean']:.5f} ± {r['std']:.5f} (n={r['n']})" for r in rows)


def leaderboard(scores: DataFrame, by: str = "run_id") -> DataFrame:
    """Mean of each metric for each run, over all runs, and over everything (nulls mark totals)."""
    return scores.where("score IS NOT NULL").cube(by, "metric").agg(F.round(F.avg("score"), 5).alias("mean"), F.count("*").alias("n"))


def markdown(scores: DataFrame, operations: DataFrame | None = None, by: str = "run_id") -> DataFrame:
    """A table of runs and metrics as lines of text, with latency and cost where operations are given."""
    names = sorted(r[0] for r in scores.select("metric").distinct().collect())  # metrics, not rows
    table = scores.groupBy(by).pivot("metric", names).agg(F.format_number(F.avg("score"), 4))
    cells = [F.coalesce(F.col(f"`{n}`"), F.lit("-")) for n in names]
    if operations is not None:
        cost = operations.groupBy(by).agg(F.concat_ws(" / ", F.concat(F.format_number(F.avg("latency_ms"), 1), F.lit(" ms")), F.concat(F.lit("$"), F.format_number(F.sum("cost_usd"), 4))).alias("_e"))
        table, names = table.join(cost, by, "left"), [*names, "latency / cost"]
        cells.append(F.coalesce("_e", F.lit("-")))
    line = lambda *xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    head = table.sparkSession.createDataFrame([(0, "| run | " + " | ".join(names) + " |"), (1, "|" + "---|" * (len(names) + 1))], "place int, line string")
    return head.unionByName(table.select(F.lit(2).alias("place"), line(F.col(by).cast("string"), *cells).alias("line"))).orderBy("place", "line").select("line")


def write_json(scores: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """Scores by query and their means, as JSON lines under path."""
    scores.write.mode("overwrite").json(f"{path}/scores")
    aggregate(scores).withColumns({k: F.lit(v) for k, v in (meta or {}).items()}).write.mode("overwrite").json(f"{path}/summary")


def write_csv(scores: DataFrame, path: str) -> None:
    wide(scores).write.mode("overwrite").option("header", True).csv(path)
