"""From raw documents to token ids: quality rules, toxicity, near duplicates, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All stages but the
last return the columns of documents, and rows keep all columns of docs, whatever their names; ``run`` writes each stage's
rows as Parquet, reads them again, and deletes those of the stage before.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import bpe, common, decontaminate, ngram_join, quality, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the current policy keeps, measured in the row itself, without a join."""
    rows = quality.apply_policy(quality.measured(docs), quality.CURRENT)
    # a number that each reading makes anew: the optimizer would else copy the measurements into a filter that it can push down
    return rows.withColumn("nth", F.monotonically_increasing_id()).where("kept AND nth >= 0").select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows not predicted to be toxic, by a network learned from the labels of rows that are left."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.sample(docs, labels, where=toxicity.fold_of("doc_id", 3) != 1))
    return toxicity.with_scores(docs, model).where("score < 0.7").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, the one with the smallest id.  Equal ids with different texts, and
    rows without an id, are rows like others."""
    return ngram_join.representatives(docs, n=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.Index(docs, decontaminate.windows(items)).clean().select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and its ids, counted and digested, with the digest of the bytes they decode to."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", token_ids),
]
#: SQL can't express the network's scores nor the encoding; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{common.shared(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        if k:
            common.delete(spark, f"{out}/{k - 1}")
    return docs
