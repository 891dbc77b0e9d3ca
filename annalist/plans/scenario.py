"""The evaluation scenario on the order tables: customers ask, their orders answer.

A query is a customer, about two years that follow from its key; its documents are its orders, about the years
in which their lines were shipped, ranked by price; a label is the order's priority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.years import year_set
from ..operators.ranking import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked_years(key: str) -> Column:
    return F.array_sort(F.array((1995 + F.col(key) % 7).cast("int"), (1995 + (F.col(key) + 3) % 7).cast("int")))


def document_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, dft of all orders; orders without lines are about no year."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(year_set(F.collect_set(F.year("l_shipdate").cast("int"))).alias("dft"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return orders.join(lines, "doc_id", "left").select("doc_id", F.coalesce("dft", F.array().cast("array<int>")).alias("dft"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id, score, rank, priority (1-5), year of order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.year("o_orderdate").cast("int").alias("year"), F.col("o_orderstatus").alias("status"))
    return top_k(o, 1_000_000)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run with qft and dft."""
    return run(spark, sf_dir).join(document_years(spark, sf_dir), "doc_id").withColumn("qft", asked_years("query_id"))


def qrels(spark: SparkSession, sf_dir: str, graded: bool) -> DataFrame:
    o = run(spark, sf_dir)
    gain = (5 - F.col("priority")).cast("double") if graded else F.when(F.col("priority") <= 2, 1.0).otherwise(0.0)
    return o.select("query_id", "doc_id", gain.alias("gain"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as operations: type, latency, tokens."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("op_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("metric_name"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"))


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and a text about each order that names its years, an era now and then, and a duration."""
    years = document_years(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("oy")), "doc_id")
    k = F.col("doc_id")
    era = F.element_at(F.array(*map(F.lit, ("during the 1990s", "after World War II", "in the cold war", "recently", "in the past 4 years", "last decade", "within 1 day"))), (k % 7 + 1).cast("int"))
    shown = F.array_join(F.transform("dft", lambda y: y.cast("string")), ", ")
    return years.select("doc_id", F.concat(F.lit("Order "), k.cast("string"), F.lit(" of "), F.col("oy").cast("string"), F.lit(" shipped in "), shown, F.lit(" "), era, F.lit("; it took "), (k % 5 + 1).cast("string"), F.lit(" years and "), (k % 3 + 1).cast("string"), F.lit(" months.")).alias("text"), "oy")


#: The same in DuckDB, as common table expressions.
SQL = """
dfts AS (SELECT o_orderkey AS doc_id, coalesce(y, []) AS dft FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT CAST(year(l_shipdate) AS INTEGER))) AS y FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
run AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_totalprice AS score, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
ranked AS (SELECT run.*, dft, list_sort([CAST(1995 + query_id % 7 AS INTEGER), CAST(1995 + (query_id + 3) % 7 AS INTEGER)]) AS qft FROM run JOIN dfts USING (doc_id)),
rel AS MATERIALIZED (SELECT *, len(list_intersect(qft, dft)) AS shared, len(list_intersect(qft, dft)) * 1.0 / len(list_distinct(list_concat(qft, dft))) AS sim FROM ranked),
ks AS (SELECT unnest([5, 10, 20]) AS k),
texts AS (SELECT o_orderkey AS doc_id, year(o_orderdate) AS oy, 'Order ' || o_orderkey || ' of ' || year(o_orderdate) || ' shipped in ' || array_to_string(dft, ', ') || ' ' ||
  ['during the 1990s', 'after World War II', 'in the cold war', 'recently', 'in the past 4 years', 'last decade', 'within 1 day'][o_orderkey % 7 + 1] || '; it took ' || (o_orderkey % 5 + 1) || ' years and ' || (o_orderkey % 3 + 1) || ' months.' AS text
  FROM orders JOIN dfts ON doc_id = o_orderkey),
ops AS (SELECT event_id AS op_id, ts, user_id, event_type AS metric_name, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt_tokens FROM events)
"""
