"""Batch annotation of queries and their passages, with resume.

Queries come as rows (id or qid, query, gold_ids, negative_ids); passages as (doc_id, text).  What has been written
already is left out by an anti-join; an annotator makes structs for queries and passages; blank and unknown
passages are skipped; results are appended as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.years import document_years, query_years

# The annotation fields.
QUERY_FIELDS = "query_summary string, temporal_intent string, temporal_signals array<string>, temporal_events array<string>, key_time_anchors array<string>, expected_granularity string, retrieval_reasoning string, retrieval_plan array<struct<step:int,action:string>>"
SCOPE = "start_iso string, end_iso string, granularity string"


def pending(queries: DataFrame, done: DataFrame | None) -> DataFrame:
    """Queries whose id isn't among those done; done has id or qid."""
    q = queries.withColumn("id", F.coalesce(*(F.col(c).cast("string") for c in ("id", "qid") if c in queries.columns)))
    if done is None:
        return q
    ids = F.coalesce(*(F.col(c).cast("string") for c in ("id", "qid") if c in done.columns))
    return q.join(done.select(ids.alias("id")).where("id IS NOT NULL").distinct(), "id", "left_anti")


def query_guidance(query: Column, current_year: int) -> Column:
    """What a query asks for in time, by rules."""
    years = query_years(query, current_year)
    anchors = F.transform(years, lambda y: y.cast("string"))
    plan = F.transform(anchors, lambda a, i: F.struct((i + 1).alias("step"), F.concat(F.lit("find passages about "), a).alias("action")))
    return F.struct(F.substring(query, 1, 200).alias("query_summary"), text.question_focus(query).alias("temporal_intent"), anchors.alias("key_time_anchors"), F.when(F.size(years) == 0, "none").otherwise("year").alias("expected_granularity"), plan.alias("retrieval_plan"))


def passage_annotation(doc_id: Column, passage: Column) -> Column:
    """What a passage says about time, by rules."""
    years = document_years(passage)
    shown = F.transform(years, lambda y: y.cast("string"))
    scope = F.struct(F.coalesce(F.trim(F.element_at(shown, 1)), F.lit("")).alias("start_iso"), F.coalesce(F.trim(F.element_at(shown, -1)), F.lit("")).alias("end_iso"), F.when(F.size(years) == 0, "unknown").otherwise("year").alias("granularity"))
    guarded = F.when(F.size(years) > 0, scope).otherwise(F.struct(F.lit("").alias("start_iso"), F.lit("").alias("end_iso"), F.lit("unknown").alias("granularity")))
    return F.struct(doc_id.alias("doc_id"), F.when(F.size(years) == 0, 0.0).otherwise(1.0).alias("confidence"), shown.alias("time_mentions"), guarded.alias("time_scope_guess"))


def annotate(queries: DataFrame, passages: DataFrame, current_year: int, max_gold: int = 0, max_negative: int = 0, chars: int = 6000) -> DataFrame:
    """id, query_guidance, and annotations of gold and negative passages in their order.  0: all of them."""
    g = queries.withColumn("query_guidance", query_guidance(F.col("query"), current_year))
    sides = []
    for side, most in (("gold", max_gold), ("negative", max_negative)):
        ids = F.coalesce(F.col(f"{side}_ids"), F.array().cast("array<string>"))
        sides.append(queries.select("id", F.lit(side).alias("side"), F.posexplode(F.slice(ids, 1, most) if most else ids).alias("pos", "doc_id")))
    asked = sides[0].unionByName(sides[1]).join(passages.select(F.col("doc_id").cast("string").alias("doc_id"), F.substring("text", 1, chars).alias("text")), "doc_id").where("trim(text) <> ''")
    made = asked.select("id", "side", F.struct("pos", passage_annotation(F.col("doc_id"), F.col("text")).alias("a")).alias("x"))
    lists = made.groupBy("id").pivot("side", ["gold", "negative"]).agg(F.array_sort(F.collect_list("x")))  # a query's own passages
    lists = lists.select("id", *(F.transform(F.col(s), lambda x: x["a"]).alias(f"{s}_passage_annotations") for s in ("gold", "negative")))
    return g.join(lists, "id", "left")


def label_batch(queries: DataFrame, passages: DataFrame, out: str, current_year: int, **options) -> int:
    """Annotate what ``out`` doesn't hold yet and append it; returns how many queries are new."""
    spark = queries.sparkSession
    try:
        done = spark.read.json(out)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    if done is not None and not {"id", "qid"} & set(done.columns):
        done = None
    todo = pending(queries, done).persist()
    try:
        n = todo.count()
        if n:
            annotate(todo, passages, current_year, **options).write.mode("append").json(out)
        return n
    finally:
        todo.unpersist()
