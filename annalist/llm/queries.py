"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_extract, id_store, licenses, lm_scoring, ngram_join, quality, token_counts, toxicity
from .common import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), order=3, folds=10, excluded=0, held=9)
    return scored.withColumn("held_out", F.col("fold") == 0).drop("fold")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger under the current policy, with the bits of failed rules and, on every row, the corpus's
    ablation of each rule: how many documents it alone rejects."""
    rows = quality.store(table(spark, sf_dir, "documents"), f"{shared(spark)}/ledger-{uuid.uuid4().hex}")
    return quality.with_ablations(quality.apply_policy(rows, quality.CURRENT), quality.CURRENT).drop("n_lines", "n_stutter")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=5)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with the notices found in it: how many, the first one, its coverage and span."""
    docs = table(spark, sf_dir, "documents")
    return licenses.per_document(docs)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each token counted in the line of its first character."""
    return token_counts.by_section(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule="first")


def op10_token_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = id_store.new_path(spark)
    id_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out, end_id=1)
    return id_store.Store(spark, out).digests()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_byte_bpe, op3_html_extraction, op4_quality_rules, op5_decontamination, op6_toxicity, op7_ngram_jaccard_join, op8_license_scan, op9_token_counts, op10_token_id_store)
}
ORACLE: dict[str, str] = {"op4_quality_rules": quality.ORACLE_SQL, "op5_decontamination": decontaminate.ORACLE_SQL}
