"""Retrieval metrics at several cut-offs, in one plan for all of them.

Input is a ranked list in long form: query_id, doc_id, rank (from 1), with what a metric needs beside it:
qft and dft (arrays of years of the query and the document) or gain (a label, null for none).  All windows and the
final aggregation are partitioned by query, so one shuffle serves every metric and every k; results are
long: query_id, metric, k, score.  Queries' lists are short (what a ranking returns), whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sets
from ..functions.years import year_set

KS = (5, 10, 20)
FOCUS = ("temporal_precision", "temporal_recall", "temporal_ndcg", "temporal_mrr", "temporal_map", "temporal_year_precision", "temporal_year_recall", "temporal_diversity")
# Kinds of questions about change.
CHANGE = ("change_over_time", "trends_changes", "trends_changes_and_cross_period")
GOLD = ("temporal_recall", "temporal_ndcg", "temporal_mrr")


def _long(wide: DataFrame, names: list[tuple[str, int]], digits: int = 5) -> DataFrame:
    cells = [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.round(F.coalesce(F.col(f"{m}@{k}"), F.lit(0.0)), digits).alias("score")) for m, k in names]
    return wide.select("query_id", F.inline(F.array(*cells)))


def _discounted(gain: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), gain) - 1) / F.log2(rank + 1)


def focus(ranked: DataFrame, ks=KS, metrics=FOCUS, threshold: float = 0.0, mode: str = "count", total_relevant: str | None = None, scope: str | None = None) -> DataFrame:
    """Metrics by years.  A document is relevant if it shares a year with the query; with a threshold, for
    precision and average precision if the Jaccard similarity is over it (mode "jaccard") or else if more years than
    that are shared.  total_relevant, scope: columns with the number of relevant documents (default: those in the
    whole list) and of years in scope (default: any year is full diversity)."""
    q = Window.partitionBy("query_id")
    shared, similar = sets.overlap("qft", "dft"), sets.jaccard("qft", "dft")
    r = ranked.withColumn("_shared", shared).withColumn("_sim", similar)
    by_share = F.col("_shared") > threshold
    strict = (F.col("_sim") > threshold) if mode == "jaccard" and threshold > 0 else by_share if mode == "count" else F.col("_shared") > 0
    r = r.withColumn("_hit", strict).withColumn("_met", by_share)
    r = r.withColumn("_seen", F.sum(F.col("_hit").cast("int")).over(q.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("_gain", 4.0 * F.col("_sim"))
    if "temporal_ndcg" in metrics:
        for k in ks:  # the ideal order is that of the same first k
            r = r.withColumn(f"_ideal{k}", F.row_number().over(q.orderBy((F.col("rank") <= k).desc(), F.col("_gain").desc(), "rank")))
    aggs, names = [], []
    for k in ks:
        top = F.col("rank") <= k
        hits = F.sum(F.when(top & F.col("_hit"), 1).otherwise(0))
        years = year_set(F.flatten(F.collect_list(F.when(top, F.coalesce(F.col("dft"), F.array().cast("array<int>"))))))
        asked = F.first("qft", ignorenulls=True)
        ideal = F.sum(F.when(top, _discounted(F.col("_gain"), F.col(f"_ideal{k}")))) if "temporal_ndcg" in metrics else None
        total = F.first(total_relevant) if total_relevant else F.sum((F.col("_shared") > 0).cast("int"))
        span = F.first(scope) if scope else F.lit(None).cast("int")
        made = {
            "temporal_precision": lambda: sets.ratio(hits, F.least(F.lit(k), F.count("*"))),
            "temporal_recall": lambda: sets.ratio(F.sum(F.when(top & F.col("_met"), 1).otherwise(0)), total),
            "temporal_ndcg": lambda: sets.ratio(F.sum(F.when(top, _discounted(F.col("_gain"), F.col("rank")))), ideal),
            "temporal_mrr": lambda: 1.0 / F.min(F.when(top & F.col("_met"), F.col("rank"))),
            "temporal_map": lambda: sets.ratio(F.sum(F.when(top & F.col("_hit"), F.col("_seen") / F.col("rank"))), hits),
            "temporal_year_precision": lambda: sets.ratio(sets.overlap(years, asked), F.size(years)),
            "temporal_year_recall": lambda: sets.ratio(sets.overlap(years, asked), sets.size(asked)),
            "temporal_diversity": lambda: F.when(F.size(years) == 0, 0.0).when(span.isNull() | (span <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.size(years) / F.greatest(span, F.lit(1)))),
        }
        for m in metrics:
            aggs.append(made[m]().alias(f"{m}@{k}"))
            names.append((m, k))
    return _long(r.groupBy("query_id").agg(*aggs), names)


def gold(run: DataFrame, qrels: DataFrame, ks=KS, metrics=GOLD) -> DataFrame:
    """Metrics by labels (query_id, doc_id, gain; binary labels have gain 1).  Recall counts distinct labelled
    documents; the ideal order is that of all labels.  A document that is listed twice counts where it comes first.
    Queries without labels score 0."""
    labels = qrels.where("gain > 0").groupBy("query_id", F.col("doc_id").cast("string").alias("doc_id")).agg(F.max("gain").cast("double").alias("gain"))
    q = Window.partitionBy("query_id")
    first = run.groupBy("query_id", F.col("doc_id").cast("string").alias("doc_id")).agg(F.min("rank").alias("rank"))
    listed = first.join(labels, ["query_id", "doc_id"], "full")  # a query with labels and an empty list scores 0
    ideal = labels.withColumn("_i", F.row_number().over(q.orderBy(F.col("gain").desc(), "doc_id")))
    best = ideal.groupBy("query_id").agg(F.count("*").alias("_n"), *(F.sum(F.when(F.col("_i") <= k, _discounted(F.col("gain"), F.col("_i")))).alias(f"_ideal{k}") for k in ks))
    aggs = []
    for k in ks:
        hit = (F.col("rank") <= k) & F.col("gain").isNotNull()
        aggs += [F.sum(hit.cast("int")).alias(f"_hits{k}"), F.sum(F.when(hit, _discounted(F.col("gain"), F.col("rank")))).alias(f"_dcg{k}"), F.min(F.when(hit, F.col("rank"))).alias(f"_first{k}")]
    wide = listed.groupBy("query_id").agg(*aggs).join(best, "query_id", "left")
    made = {"temporal_recall": lambda k: sets.ratio(F.col(f"_hits{k}"), F.coalesce("_n", F.lit(0))), "temporal_ndcg": lambda k: sets.ratio(F.col(f"_dcg{k}"), F.coalesce(f"_ideal{k}", F.lit(0.0))), "temporal_mrr": lambda k: 1.0 / F.col(f"_first{k}")}
    names = [(m, k) for m in metrics for k in ks]
    return _long(wide.select("query_id", *(made[m](k).alias(f"{m}@{k}") for m, k in names)), names)


def anchor_f1(found: Column, wanted: Column) -> Column:
    """F1 of two sets of anchors, whatever their case."""
    f, w = (F.array_distinct(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda y: F.lower(y))) for x in (found, wanted))
    both = F.size(F.array_intersect(f, w))
    return F.round(sets.ratio(2.0 * both, (F.size(f) + F.size(w)).cast("double")), 5)


def text_diversity(decades: Column, expected: Column | int = 10) -> Column:
    """Distinct decades found in the first k texts by those expected, 1 at most."""
    e = F.lit(expected) if isinstance(expected, int) else expected
    return F.round(F.least(F.lit(1.0), sets.ratio(F.size(decades).cast("double"), e)), 5)


def persistence(target: Column, baseline: Column) -> Column:
    """A score of a later period by that of an earlier one; 1 without an earlier score over 0."""
    return F.when(target.isNull() | baseline.isNull(), 0.0).when(baseline == 0, 1.0).otherwise(F.round(target / F.when(baseline != 0, baseline), 4))


def judged(judgments: DataFrame, ks=KS) -> DataFrame:
    """Metrics by judges' verdicts: query_id, rank, and verdict (0/1), is_relevant, relevance_score, graded (0-4),
    covers_baseline, covers_comparison; nulls are failed judgments.  full_coverage: the binary gain of gold
    labels is in ``gain``.  With a column temporal_focus, coverage is 0 for queries about anything but change."""
    q = Window.partitionBy("query_id")
    r = judgments.withColumn("_hit", F.coalesce(F.col("verdict") == 1, F.lit(False))).withColumn("_gain", F.least(F.lit(4.0), F.greatest(F.lit(0.0), F.coalesce(F.col("graded"), F.lit(0.0)))))
    r = r.withColumn("_seen", F.sum(F.col("_hit").cast("int")).over(q.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    for k in ks:
        r = r.withColumn(f"_ideal{k}", F.row_number().over(q.orderBy((F.col("rank") <= k).desc(), F.col("_gain").desc(), "rank")))
    aggs, names = [], []
    for k in ks:
        top = F.col("rank") <= k
        n = F.sum(top.cast("int"))
        hits = F.sum((top & F.col("_hit")).cast("int"))
        yes = F.coalesce(F.col("is_relevant"), F.lit(False))
        covered = (F.max((top & F.coalesce("covers_baseline", F.lit(False))).cast("int")) + F.max((top & F.coalesce("covers_comparison", F.lit(False))).cast("int"))) / 2.0
        if "temporal_focus" in judgments.columns:
            covered = F.when(F.first("temporal_focus", ignorenulls=True).isin(*CHANGE), covered).otherwise(0.0)
        first = 1.0 / F.min(F.when(top & yes, F.col("rank")))
        made = {
            "judged_precision": sets.ratio(F.sum(F.when(top & F.col("_hit"), F.col("_seen") / F.col("rank"))), hits),
            "judged_recall": sets.ratio(F.sum(F.when(top & yes, F.coalesce("relevance_score", F.lit(1.0))).otherwise(0.0)), n),
            "judged_ndcg": sets.ratio(F.sum(F.when(top, _discounted(F.col("_gain"), F.col("rank")))), F.sum(F.when(top, _discounted(F.col("_gain"), F.col(f"_ideal{k}"))))),
            "judged_mrr": first,
            "temporal_coverage": covered,
            "temporal_relevance": sets.ratio(hits, n),
        }
        for m, x in made.items():
            aggs.append(x.alias(f"{m}@{k}"))
            names.append((m, k))
    return _long(r.groupBy("query_id").agg(*aggs), names)


def full_coverage_ndcg(ndcg: DataFrame, coverage: DataFrame) -> DataFrame:
    """NDCG where the list covers both periods, else 0."""
    n, c = ndcg.where("metric = 'temporal_ndcg'"), coverage.where("metric = 'temporal_coverage'")
    return n.join(c.select("query_id", "k", F.col("score").alias("_c")), ["query_id", "k"], "left").select("query_id", F.lit("ndcg_full_coverage").alias("metric"), "k", F.when(F.col("_c") == 1.0, F.col("score")).otherwise(0.0).alias("score"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
