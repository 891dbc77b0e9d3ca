"""Readers of query and document collections in one shape, and writers.

Files are local or in any store that Spark reads; nothing is downloaded.  Limits of 0 mean all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: The common columns, with their types.
QUERY = "query_id string, query string, gold_ids array<string>, temporal_focus string, key_time_anchors array<string>, baseline_anchor string, comparison_anchor string, is_cross_period boolean, gold_answer string, metadata map<string,string>"
# The domains of the temporal query collection, and the splits of others.
DOMAINS = ("bitcoin", "cardano", "economics", "genealogy", "history", "hsm", "iota", "law", "monero", "politics", "quant", "travel", "workplace")
SPLITS = ("train", "dev", "validation", "test")


def _limited(df: DataFrame, n: int | None) -> DataFrame:
    return df.limit(n) if n else df


def _any(df: DataFrame, *names: str, cast: str = "string") -> Column:
    """The first of some columns that is there and not null."""
    here = [F.col(n).cast(cast) for n in names if n in df.columns]
    return F.coalesce(*here) if here else F.lit(None).cast(cast)


def _check(value: str, known: tuple[str, ...], what: str) -> None:
    if value not in known:
        raise ValueError(f"{what} {value!r}: one of {', '.join(known)}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON (one array or object) or JSON lines, by the path's end."""
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    return spark.read.parquet(path)


def queries(df: DataFrame) -> DataFrame:
    """Any table of queries in the common shape: missing columns by default, others as metadata."""
    own = {"query_id", "id", "qid", "query", "question", "gold_ids", "temporal_focus", "key_time_anchors", "baseline_anchor", "comparison_anchor", "is_cross_period", "gold_answer", "answer"}
    rest = [c for c in df.columns if c not in own]
    meta = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string") if not _nested(df, c) else F.to_json(c)))), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    blank = lambda x: F.coalesce(x, F.lit(""))
    arrays = lambda n: F.coalesce(F.col(n).cast("array<string>"), F.array().cast("array<string>")) if n in df.columns else F.array().cast("array<string>")
    place = F.monotonically_increasing_id().cast("string")
    return df.select(
        F.coalesce(_any(df, "query_id", "id", "qid"), place).alias("query_id"),
        blank(_any(df, "query", "question")).alias("query"),
        arrays("gold_ids").alias("gold_ids"),
        F.coalesce(_any(df, "temporal_focus"), F.lit("specific_time")).alias("temporal_focus"),
        arrays("key_time_anchors").alias("key_time_anchors"),
        blank(_any(df, "baseline_anchor")).alias("baseline_anchor"),
        blank(_any(df, "comparison_anchor")).alias("comparison_anchor"),
        F.coalesce(_any(df, "is_cross_period", cast="boolean"), F.lit(False)).alias("is_cross_period"),
        _any(df, "gold_answer", "answer").alias("gold_answer"),
        meta.alias("metadata"),
    )


def _nested(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("array", "map", "struct")


def read_domain_queries(spark: SparkSession, root: str, domain: str, max_samples: int = 0) -> DataFrame:
    """Queries of one domain from steps/<domain>, or from examples/<domain> if that can't be read."""
    _check(domain, DOMAINS, "domain")
    try:
        df = spark.read.parquet(f"{root}/steps/{domain}")
    except Exception:
        df = spark.read.parquet(f"{root}/examples/{domain}")
    q = queries(_limited(df, max_samples))
    cross = text.is_cross_period("temporal_focus", "query")
    first, last = text.period_anchors(cross, F.col("key_time_anchors"))
    return q.withColumn("is_cross_period", cross).withColumn("baseline_anchor", first).withColumn("comparison_anchor", last)


def read_domain_documents(spark: SparkSession, root: str, domain: str, max_docs: int = 0) -> DataFrame:
    _check(domain, DOMAINS, "domain")
    return _limited(spark.read.parquet(f"{root}/documents/{domain}").select(F.col("id").cast("string").alias("doc_id"), F.col("content").alias("text")), max_docs)


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in DOMAINS], "domain string")


def read_time_questions(spark: SparkSession, path: str, split: str = "test", subset: str | None = None, max_samples: int = 0) -> DataFrame:
    """Questions about times: optional type, the first of listed answers, context or passage as metadata."""
    _check(split, SPLITS, "split")
    df = read(spark, path)
    if subset and "type" in df.columns:
        df = df.where(F.col("type") == subset)
    answers = next((c for c in ("answer", "answers", "targets") if c in df.columns), None)
    if answers:
        got = F.try_element_at(F.col(answers), F.lit(1)) if df.schema[answers].dataType.typeName() == "array" else F.col(answers)
        df = df.withColumn("gold_answer", got.cast("string")).drop(answers)
    q = queries(_limited(df, max_samples))
    return q.withColumn("temporal_focus", text.question_focus("query")).withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, v: k != "context"), F.map_filter(F.create_map(F.lit("context"), F.coalesce(F.try_element_at("metadata", F.lit("context")), F.try_element_at("metadata", F.lit("passage")))), lambda k, v: v.isNotNull())))


def read_situated_questions(spark: SparkSession, path: str, max_samples: int = 0) -> DataFrame:
    """JSON lines that were fetched before; lines that can't be parsed are left out."""
    df = spark.read.option("mode", "DROPMALFORMED").schema("id string, question string, edited_question string, date string, location string, answer array<string>, any_answer array<string>").json(path)
    named = df.withColumn("query", F.coalesce("edited_question", "question")).withColumn("gold_answer", F.coalesce(F.try_element_at("answer", F.lit(1)), F.try_element_at("any_answer", F.lit(1)))).drop("question", "edited_question", "answer", "any_answer")
    return queries(_limited(named, max_samples))


def read_typed_questions(spark: SparkSession, path: str, split: str = "test", question_type: str | None = None, max_samples: int = 0) -> DataFrame:
    """Questions with a question_type; the filter on it ignores case."""
    _check(split, SPLITS, "split")
    df = read(spark, path)
    if question_type:
        df = df.where(F.lower("question_type") == question_type.lower())
    kind = F.try_element_at("metadata", F.lit("question_type"))
    return queries(_limited(df, max_samples)).withColumn("temporal_focus", text.typed_question_focus(kind, "query"))


def read_reasoning_tasks(spark: SparkSession, path: str, max_samples: int = 0) -> DataFrame:
    """Tasks with a type; an empty table in the common shape if there is nothing to read."""
    try:
        df = read(spark, path)
    except Exception:
        return spark.createDataFrame([], QUERY)
    return queries(_limited(df, max_samples)).withColumn("temporal_focus", text.reasoning_focus(F.try_element_at("metadata", F.lit("type"))))


def read_query_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of queries to annotate; bad lines are dropped."""
    return spark.read.option("mode", "DROPMALFORMED").schema("id string, qid string, query string, gold_ids array<string>, negative_ids array<string>").json(path).where("id IS NOT NULL OR qid IS NOT NULL")


def read_corpus(spark: SparkSession, root: str, max_chars: int = 0) -> DataFrame:
    """doc_id (path below root, without .txt) and text of a tree of text files."""
    base = root.rstrip("/")
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(base, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")
    name = F.regexp_replace(F.substring_index(path, base.removeprefix("file://") + "/", -1), r"\.txt$", "")
    return df.select(name.alias("doc_id"), (F.substring("value", 1, max_chars) if max_chars else F.col("value")).alias("text"))


# Operations on collections


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows in which every named column equals its value; a null value asks for nulls."""
    return df.where(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in values.items()), F.lit(True)))


def cross_period_only(df: DataFrame) -> DataFrame:
    return df.where("is_cross_period")


def sample(df: DataFrame, n: int, seed: int = 42, key: str = "query_id") -> DataFrame:
    """n rows without replacement, the same ones for the same seed wherever they are stored."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), key).limit(n)


def flat(df: DataFrame, *keys: str) -> DataFrame:
    """With named metadata as columns."""
    return df.select("*", *(F.try_element_at("metadata", F.lit(k)).alias(k) for k in keys))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    """Keyed by model and task, which become folders."""
    df.write.mode("append").partitionBy("model", "task").parquet(path)
