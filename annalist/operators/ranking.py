"""Ranking: top-k of scores, exclusion, keyword overlap, BM25, cosine.

Term retrieval is an equi-join on terms (an inverted index), never a join of all queries with all
documents; the heaviest terms are split by adaptive execution.  Cosine compares a stated set of query
vectors with all documents in blocks: queries are cut to blocks of bounded size, each of which meets
every document partition, and keeps its k best before anything is shuffled.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship

QUERY_BLOCK = 256
QUERY_BYTES = 64 << 20


def top_k(scores: DataFrame, k: int = 1000, query: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """rank 1..k of each query by score, highest first; ties in order of ``tie``.  Of a document that
    is scored twice the last score counts: callers keep one row for each."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie).asc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exclude(run: DataFrame, excluded: DataFrame) -> DataFrame:
    """Without the excluded documents of each query; the id N/A excludes nothing."""
    return run.join(excluded.where("doc_id IS NOT NULL AND CAST(doc_id AS STRING) <> 'N/A'").select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")


def cut(run: DataFrame, k: int) -> DataFrame:
    return run.where(F.col("rank") <= k)


def terms(text: Column | str) -> Column:
    """Runs of letters A-Z, in lower case, and digits; other letters stand between terms, in any language."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(c, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), "[^a-z0-9]+"), "")


def keyword_overlap(docs: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """query_id, doc_id, score: how many distinct terms both have; of queries and documents with any."""
    d = docs.select("doc_id", F.explode(F.array_distinct(terms("text"))).alias("term"))
    q = queries.select("query_id", F.explode(F.array_distinct(terms("query"))).alias("term"))
    return top_k(d.join(q, "term").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score")), k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 100, k1: float = 0.9, b: float = 0.4, query_weighting: str = "bm25") -> DataFrame:
    """query_id, doc_id, score, rank by BM25: idf = ln(1 + (N - df + 0.5) / (df + 0.5)) and
    weight = idf * tf / (tf + k1 (1 - b + b * length / mean length)).  The query's terms are weighted the
    same way (with the corpus's idf and mean length), or by their counts for query_weighting "tf"."""
    wanted = queries.select("query_id", terms("query").alias("t")).select("query_id", F.size("t").alias("qlength"), F.explode("t").alias("term")).groupBy("query_id", "qlength", "term").agg(F.count("*").alias("qtf"))
    asked = wanted.select("term").distinct()
    # only postings that some query asks for; counted before they are shuffled
    d = docs.select("doc_id", terms("text").alias("t")).select("doc_id", F.size("t").alias("length"), "t")
    size = docs.select(F.size(terms("text")).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()  # one row
    tf = d.select("doc_id", "length", F.explode("t").alias("term")).join(asked, "term", "left_semi").groupBy("term", "doc_id", "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n, mean = F.lit(size["n"]), F.lit(size["mean"] or 1.0)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    stats = df.select("term", idf.alias("idf"))
    weigh = lambda f, length: F.col("idf") * F.col(f) / (F.col(f) + k1 * (1 - b + b * F.col(length) / mean))
    q = wanted.join(stats, "term")
    queries_w = q.select("query_id", "term", "idf", (weigh("qtf", "qlength") if query_weighting == "bm25" else F.col("qtf").cast("double")).alias("wq"))
    return top_k(tf.join(queries_w, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(weigh("tf", "length") * F.col("wq")), 6).alias("score")), k)


def cosine(queries: DataFrame, docs: DataFrame, k: int = 100, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, doc_id, score, rank: the k nearest documents of each query (id, vector) by cosine; a zero
    vector has similarity 0 with all."""
    spark = docs.sparkSession
    ship(spark)
    vectors = lambda df, key: df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    asked = vectors(queries, "query_id")
    size = asked.agg(F.coalesce(F.sum(8 * F.size("v") + 8), F.lit(0))).first()[0]
    if size > QUERY_BYTES:
        raise ValueError(f"the stated query set holds {size} bytes of vectors; at most {QUERY_BYTES} are sent to each executor: ask in several calls")
    got = asked.toPandas().sort_values("query_id")
    if got.empty:
        return top_k(spark.createDataFrame([], "query_id long, doc_id long, score double"), k)
    sent = spark.sparkContext.broadcast((got["query_id"].to_numpy(np.int64), _unit(np.array(got["v"].tolist(), float))))
    near = vectors(docs, "doc_id").mapInArrow(_nearest(sent, k, digits), "query_id long, doc_id long, score double")
    return top_k(near, k)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm > 0, norm, 1)


def _nearest(sent, k: int, digits: int) -> Callable:
    """Of a partition of documents, the k nearest of each query: what is kept meets each batch anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
        for b in batches:
            if not b.num_rows:
                continue
            docs = b.column("doc_id").to_numpy()
            m = _unit(np.array(b.column("v").to_pylist(), float)).T
            for lo in range(0, len(ids), QUERY_BLOCK):
                for i, s in enumerate(np.round(q[lo : lo + QUERY_BLOCK] @ m, digits), lo):
                    # all that reach the k-th score, then by score and id: ties at the border stay in order
                    near = np.flatnonzero(s >= -np.partition(-s, k - 1)[k - 1]) if len(s) > k else np.arange(len(s))
                    d, x = np.concatenate([best[i][0], docs[near]]), np.concatenate([best[i][1], s[near]])
                    order = np.lexsort((d, -x))[:k]
                    best[i] = d[order], x[order]
        for lo in range(0, len(ids), QUERY_BLOCK):
            some = best[lo : lo + QUERY_BLOCK]
            sizes = [len(d) for d, _ in some]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + QUERY_BLOCK], sizes)), pa.array(np.concatenate([d for d, _ in some])), pa.array(np.concatenate([x for _, x in some]))], names=["query_id", "doc_id", "score"])

    return run


def missing(docs: DataFrame, cached: DataFrame, text: str = "text") -> DataFrame:
    """Documents without a cached embedding of their present text: the cache is keyed by id and hash."""
    now = docs.withColumn("text_hash", F.xxhash64(text))
    return now.join(cached.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_anti")


#: name -> encoder(texts) -> vectors; neural encoders are registered by those who have them.
ENCODERS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def register_encoder(name: str, encoder: Callable[[list[str]], np.ndarray]) -> None:
    ENCODERS[name] = encoder


def hashing_encoder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder without a model: signed hashes of words, to unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                out[i, h % dimensions] += 1 if h >> 63 else -1
        return _unit(out)

    return encode


register_encoder("hashing", hashing_encoder())


def embed(docs: DataFrame, encoder: str | Callable = "hashing", key: str = "doc_id", text: str = "text", instruction: str = "", batch: int = 1024) -> DataFrame:
    """key, text_hash, embedding by a registered or given encoder, batch by batch."""
    ship(docs.sparkSession)
    encode = ENCODERS[encoder] if isinstance(encoder, str) else encoder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                x = b.slice(lo, batch)
                v = encode([instruction + (t or "") for t in x.column("t").to_pylist()])
                yield pa.RecordBatch.from_arrays([x.column(key), x.column("text_hash"), pa.array([r.tolist() for r in np.asarray(v, np.float32)], pa.list_(pa.float32()))], names=[key, "text_hash", "embedding"])

    rows = docs.select(key, F.xxhash64(text).alias("text_hash"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text_hash long, embedding array<float>")


#: name -> retriever(docs, queries, k) -> query_id, doc_id, score, rank.
RETRIEVERS: dict[str, Callable[..., DataFrame]] = {"bm25": bm25, "keyword": keyword_overlap, "cosine": lambda docs, queries, k=100, **options: cosine(queries, docs, k, **options)}


def register_retriever(name: str, retriever: Callable[..., DataFrame]) -> None:
    RETRIEVERS[name.lower()] = retriever


def get_retriever(name: str) -> Callable[..., DataFrame]:
    if name.lower() not in RETRIEVERS:
        raise ValueError(f"no retriever named {name}; known: {', '.join(list_retrievers())}")
    return RETRIEVERS[name.lower()]


def list_retrievers() -> list[str]:
    return sorted(RETRIEVERS)
