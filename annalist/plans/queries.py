"""One query for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sets, spans, text, years
from ..operators import efficiency, evaluate, guidance, judge, meta, metrics, ranking, reasoning, results
from ..sources import datasets
from ..streaming import ops as stream_ops
from . import scenario as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
NOW = 2002  # the current year of relative phrases
KS = (5, 10, 20)


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {S.SQL} {sql}"
        return f

    return add


def shown(c) -> F.Column:
    return F.array_join(F.transform(c, lambda y: y.cast("string")), ",")


# Years of texts

_SQL_YEARS = """list_sort(list_distinct(list_concat(
  list_transform(regexp_extract_all(text, '\\b(1[89][0-9][0-9]|20[0-9][0-9])\\b', 1), lambda y: CAST(y AS INTEGER)),
  flatten(list_transform(regexp_extract_all(lower(text), '\\b(?:the\\s+)?(1[89][0-9]0|20[0-9]0)s\\b', 1), lambda d: range(CAST(d AS INTEGER), CAST(d AS INTEGER) + 10))))))"""
_SQL_PHRASE = "CASE WHEN lower(text) LIKE '%world war ii%' THEN range(1939, 1946) WHEN lower(text) LIKE '%cold war%' THEN range(1947, 1992) ELSE [] END"
_SQL_RELATIVE = f"CASE WHEN text LIKE '%recently%' THEN range({NOW} - 2, {NOW} + 1) WHEN text LIKE '%past 4 years%' THEN range({NOW} - 4, {NOW} + 1) WHEN text LIKE '%last decade%' THEN range({NOW} - 10, {NOW}) ELSE [] END"


@query(f"SELECT doc_id, array_to_string({_SQL_YEARS}, ',') AS years FROM texts")
def explicit_years(spark, d):
    return S.order_texts(spark, d).select("doc_id", shown(years.document_years("text")).alias("years"))


@query(f"SELECT doc_id, array_to_string({_SQL_PHRASE}, ',') AS years FROM texts")
def phrase_years(spark, d):
    return S.order_texts(spark, d).select("doc_id", shown(years.phrase_years("text")).alias("years"))


@query(f"SELECT doc_id, array_to_string({_SQL_RELATIVE}, ',') AS years FROM texts")
def relative_years(spark, d):
    return S.order_texts(spark, d).select("doc_id", shown(years.relative_years("text", NOW)).alias("years"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat({_SQL_YEARS}, {_SQL_PHRASE}), {_SQL_RELATIVE}))), ',') AS years FROM texts")
def query_years(spark, d):
    return S.order_texts(spark, d).select("doc_id", shown(years.query_years("text", NOW)).alias("years"))


@query("""SELECT c_custkey AS query_id, kind, y AS year, round(greatest(0.0, w), 6) AS weight FROM customer, (
  SELECT 'recently' AS kind, i AS o, -1 AS step, i, 1.0 - i * 0.1 AS w, 0 AS base FROM range(10) r(i) UNION ALL
  SELECT 'before', i, 0, i, 1.0 - i * 0.1, 0 FROM range(20) r(i) UNION ALL SELECT 'around', i, 1, i, 1.0 - abs(i) * 0.3, 0 FROM range(-2, 3) r(i)) x,
  LATERAL (SELECT CASE kind WHEN 'recently' THEN 1995 + c_custkey % 7 - o WHEN 'before' THEN 1995 + c_custkey % 7 - 1 - o ELSE 1995 + c_custkey % 7 + o END AS y) z
  UNION ALL SELECT c_custkey, 'after', y, round(greatest(0.0, 1.0 - (y - (1995 + c_custkey % 7) - 1) * 0.1), 6) FROM customer, range(1996, 2003) r(y) WHERE y > 1995 + c_custkey % 7""")
def fuzzy_years(spark, d):
    y = (1995 + F.col("c_custkey") % 7).cast("int")
    kinds = {"recently": years.fuzzy_recently(y), "before": years.fuzzy_before(y), "after": years.fuzzy_after(y, F.lit(NOW)), "around": years.fuzzy_around(y)}
    c = S.table(spark, d, "customer")
    return metrics.union_all(*(c.select(F.col("c_custkey").alias("query_id"), F.lit(k).alias("kind"), F.explode(m).alias("year", "weight")) for k, m in kinds.items())).select("query_id", "kind", F.col("year").cast("long").alias("year"), F.round("weight", 6).alias("weight"))


@query("SELECT query_id, doc_id, round(coalesce(list_sum(list_transform(dft, lambda y: CASE WHEN abs(y - (1995 + query_id % 7)) <= 2 THEN 1.0 - abs(y - (1995 + query_id % 7)) * 0.3 ELSE 0.0 END)), 0.0), 6) AS overlap FROM ranked")
def weighted_overlap(spark, d):
    m = years.fuzzy_around((1995 + F.col("query_id") % 7).cast("int"))
    return S.ranked(spark, d).withColumn("m", m).select("query_id", "doc_id", F.round(years.weighted_overlap(F.col("m"), F.col("dft")), 6).alias("overlap"))


@query("""SELECT query_id, doc_id, shared > 0 AS any_rel, sim > 0 AS jac_rel, round(CASE WHEN len(dft) = 0 THEN 0.0 ELSE sim END, 6) AS jac_score,
  len(list_intersect(qft, dft)) = 2 AS all_rel, CASE WHEN shared > 0 THEN 1.0 ELSE 0.0 END AS any_score, shared > 0 AS covers0, sim >= 0.5 AS covers5 FROM rel""")
def relevance_modes(spark, d):
    a, j, x = (sets.relevance("qft", "dft", m) for m in ("any", "jaccard", "all"))
    return S.ranked(spark, d).select("query_id", "doc_id", a[0].alias("any_rel"), j[0].alias("jac_rel"), F.round(j[1], 6).alias("jac_score"), x[0].alias("all_rel"), a[1].alias("any_score"), sets.covers("qft", "dft").alias("covers0"), sets.covers("qft", "dft", 0.5).alias("covers5"))


@query("""SELECT query_id, doc_id, array_to_string(list_sort(list_intersect(qft, dft)), ',') AS both, array_to_string(list_sort(list_distinct(list_concat(qft, dft))), ',') AS either,
  CAST(len(dft) AS INTEGER) AS n, CAST(shared AS INTEGER) AS shared, round(sim, 6) AS sim, shared = 2 AS within, array_to_string(range(qft[1], qft[2] + 1), ',') AS span FROM rel""")
def year_set_operations(spark, d):
    return S.ranked(spark, d).select("query_id", "doc_id", shown(sets.intersection("qft", "dft")).alias("both"), shown(sets.union("qft", "dft")).alias("either"), sets.size("dft").alias("n"), sets.overlap("qft", "dft").alias("shared"), F.round(sets.jaccard("qft", "dft"), 6).alias("sim"), sets.contained("qft", "dft").alias("within"), shown(years.year_range(F.col("qft")[0], F.col("qft")[1])).alias("span"))


# Ranking


@query("SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM run WHERE rank <= 10")
def top_k(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    return ranking.top_k(o, 10)


@query("SELECT query_id, doc_id FROM run WHERE doc_id % 11 <> 0")
def excluded_documents(spark, d):
    r = S.run(spark, d)
    return ranking.exclude(r, r.where("doc_id % 11 = 0").select("query_id", "doc_id")).select("query_id", "doc_id")


_TERMS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([a-z0-9]+)', 1)"
_BAG = f"list_distinct({_TERMS})"


@query(f"""SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, CAST(count(*) AS DOUBLE) AS score FROM (SELECT item_id AS query_id, unnest({_BAG.format('text')}) AS term FROM benchmark) JOIN (SELECT doc_id, unnest({_BAG.format('text')}) AS term FROM documents) USING (term) GROUP BY 1, 2)) WHERE rank <= 10""")
def keyword_overlap(spark, d):
    return ranking.get_retriever("keyword")(S.table(spark, d, "documents"), _asked(spark, d), 10)


@query(f"""SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  WITH t AS (SELECT doc_id, {_TERMS.format('text')} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
  tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  q AS (SELECT query_id, qlength, term, count(*) AS tf FROM (SELECT item_id AS query_id, len({_TERMS.format('text')}) AS qlength, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
  idf AS (SELECT term, mean, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, n)
  SELECT query_id, doc_id, round(sum(idf * tf.tf / (tf.tf + 0.9 * (1 - 0.4 + 0.4 * length / mean)) * (idf * q.tf / (q.tf + 0.9 * (1 - 0.4 + 0.4 * qlength / mean)))), 6) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term) GROUP BY 1, 2)) WHERE rank <= 10""")
def bm25(spark, d):
    """Over the whole table, with N, df and the mean length of all languages."""
    return ranking.get_retriever("bm25")(S.table(spark, d, "documents"), _asked(spark, d), 10)


def _asked(spark, d):
    return S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("""SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""")
def cosine_top_k(spark, d):
    e = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return ranking.cosine(e.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), e, 10).select("query_id", "doc_id", "score")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def missing_embeddings(spark, d):
    docs = S.table(spark, d, "documents")
    cached = docs.where("doc_id % 3 = 0").select("doc_id", F.xxhash64("text").alias("text_hash"))
    return ranking.missing(docs, cached).select("doc_id")


# Retrieval metrics

_REL = "SELECT query_id, k, round({}, 5) AS score FROM rel, ks GROUP BY query_id, k"
_UNION = "list_distinct(flatten(list(dft) FILTER (rank <= k)))"
_SQL_FOCUS = {
    "temporal_precision": _REL.format("count(*) FILTER (rank <= k AND shared > 0) * 1.0 / least(k, count(*))"),
    "temporal_recall": _REL.format("CASE WHEN count(*) FILTER (shared > 0) = 0 THEN 0.0 ELSE count(*) FILTER (rank <= k AND shared > 0) * 1.0 / count(*) FILTER (shared > 0) END"),
    "temporal_ndcg": "SELECT query_id, k, round(CASE WHEN sum(i) = 0 THEN 0.0 ELSE sum(g) / sum(i) END, 5) AS score FROM (SELECT query_id, k, (pow(2.0, 4 * sim) - 1) / log2(rank + 1) AS g, (pow(2.0, 4 * sim) - 1) / log2(row_number() OVER (PARTITION BY query_id, k ORDER BY sim DESC, rank) + 1) AS i FROM rel, ks WHERE rank <= k) GROUP BY query_id, k",
    "temporal_mrr": _REL.format("coalesce(1.0 / min(rank) FILTER (rank <= k AND shared > 0), 0.0)"),
    "temporal_map": "SELECT query_id, k, round(coalesce(sum(s * 1.0 / rank) FILTER (rank <= k AND shared > 0) / count(*) FILTER (rank <= k AND shared > 0), 0.0), 5) AS score FROM (SELECT *, sum(CAST(shared > 0 AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS s FROM rel), ks GROUP BY query_id, k",
    "temporal_year_precision": _REL.format(f"CASE WHEN len({_UNION}) = 0 THEN 0.0 ELSE len(list_intersect({_UNION}, first(qft))) * 1.0 / len({_UNION}) END"),
    "temporal_year_recall": _REL.format(f"len(list_intersect({_UNION}, first(qft))) * 1.0 / 2"),
    "temporal_diversity": _REL.format(f"CASE WHEN len({_UNION}) = 0 THEN 0.0 ELSE least(1.0, len({_UNION}) / 7.0) END"),
}


def _focus(metric: str):
    def f(spark, d):
        ranked = S.ranked(spark, d).withColumn("scope", F.lit(7))
        return metrics.focus(ranked, KS, (metric,), scope="scope").drop("metric")

    f.__name__ = f"focus_{metric}"
    return f


for _m, _sql in _SQL_FOCUS.items():
    query(_sql)(_focus(_m))


@query(" UNION ALL ".join(f"SELECT query_id, '{m}' AS metric, k, score FROM ({s})" for m, s in _SQL_FOCUS.items()))
def focus_all_metrics(spark, d):
    """All of them at all cut-offs in one plan."""
    return metrics.focus(S.ranked(spark, d).withColumn("scope", F.lit(7)), KS, scope="scope")


_SQL_GOLD = {
    "temporal_recall": "SELECT query_id, k, round(CASE WHEN count(*) FILTER (priority <= 2) = 0 THEN 0.0 ELSE count(*) FILTER (priority <= 2 AND rank <= k) * 1.0 / count(*) FILTER (priority <= 2) END, 5) AS score FROM run, ks GROUP BY query_id, k",
    "temporal_mrr": "SELECT query_id, k, round(coalesce(1.0 / min(rank) FILTER (priority <= 2 AND rank <= k), 0.0), 5) AS score FROM run, ks GROUP BY query_id, k",
    "temporal_ndcg": "SELECT query_id, k, round(CASE WHEN coalesce(sum(i) FILTER (ir <= k), 0) = 0 THEN 0.0 ELSE coalesce(sum(g) FILTER (rank <= k), 0) / sum(i) FILTER (ir <= k) END, 5) AS score FROM (SELECT query_id, rank, (pow(2.0, 5 - priority) - 1) / log2(rank + 1) AS g, ir, (pow(2.0, 5 - priority) - 1) / log2(ir + 1) AS i FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, doc_id) AS ir FROM run)), ks GROUP BY query_id, k",
}


def _gold(metric: str):
    def f(spark, d):
        return metrics.gold(S.run(spark, d).select("query_id", "doc_id", "rank"), S.qrels(spark, d, metric == "temporal_ndcg"), KS, (metric,)).drop("metric")

    f.__name__ = f"gold_{metric}"
    return f


for _m, _sql in _SQL_GOLD.items():
    query(_sql)(_gold(_m))

_SQL_TOP_TEXT = "SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS text FROM run JOIN texts USING (doc_id) WHERE rank <= 10 GROUP BY query_id"


def _top_text(spark, d):
    t = S.run(spark, d).where("rank <= 10").join(S.order_texts(spark, d).select("doc_id", "text"), "doc_id")
    return t.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("text"))


@query(f"SELECT query_id, round(least(1.0, len(list_distinct(regexp_extract_all(text, '\\b((?:19|20)[0-9])[0-9]\\b', 1))) / 10.0), 5) AS score FROM ({_SQL_TOP_TEXT})")
def text_diversity(spark, d):
    return _top_text(spark, d).select("query_id", metrics.text_diversity(years.decades_1900("text")).alias("score"))


_SQL_F1 = "round(2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1})), 5)"


@query(f"SELECT query_id, {_SQL_F1.format('f', 'w')} AS score FROM (SELECT query_id, list_distinct(list_concat(regexp_extract_all(text, '\\b(19[0-9][0-9]|20[0-9][0-9])\\b', 1), regexp_extract_all(lower(text), '\\b((?:the\\s+)?(?:19|20)?[0-9]0s)\\b', 1))) AS f, [CAST(1995 + query_id % 7 AS VARCHAR), CAST(1995 + (query_id + 3) % 7 AS VARCHAR)] AS w FROM ({_SQL_TOP_TEXT}))")
def anchor_coverage(spark, d):
    wanted = F.transform(S.asked_years("query_id"), lambda y: y.cast("string"))
    return _top_text(spark, d).select("query_id", metrics.anchor_f1(years.anchors("text"), wanted).alias("score"))


@query("SELECT query_id, CASE WHEN coalesce(b, 0) = 0 AND t IS NOT NULL AND b IS NOT NULL THEN 1.0 WHEN t IS NULL OR b IS NULL THEN 0.0 ELSE round(t / b, 4) END AS score FROM (SELECT query_id, avg(CAST(shared > 0 AS DOUBLE)) FILTER (year >= 1998) AS t, avg(CAST(shared > 0 AS DOUBLE)) FILTER (year < 1998) AS b FROM rel GROUP BY query_id)")
def temporal_persistence(spark, d):
    hit = (sets.overlap("qft", "dft") > 0).cast("double")
    g = S.ranked(spark, d).groupBy("query_id").agg(F.avg(F.when(F.col("year") >= 1998, hit)).alias("t"), F.avg(F.when(F.col("year") < 1998, hit)).alias("b"))
    return g.select("query_id", metrics.persistence(F.col("t"), F.col("b")).alias("score"))


# Judges

_JUDGED = f"""SELECT query_id, metric, k, round(coalesce(CASE metric
  WHEN 'judged_precision' THEN sum(s * 1.0 / rank) FILTER (rank <= k AND shared > 0) / count(*) FILTER (rank <= k AND shared > 0)
  WHEN 'judged_recall' THEN coalesce(sum(round(sim, 6)) FILTER (rank <= k AND shared > 0), 0.0) / count(*) FILTER (rank <= k)
  WHEN 'judged_ndcg' THEN CASE WHEN sum(CASE WHEN rank <= k THEN (pow(2.0, round(4 * sim, 6)) - 1) / log2(ideal + 1) END) = 0 THEN 0.0 ELSE sum(CASE WHEN rank <= k THEN (pow(2.0, round(4 * sim, 6)) - 1) / log2(rank + 1) END) / sum(CASE WHEN rank <= k THEN (pow(2.0, round(4 * sim, 6)) - 1) / log2(ideal + 1) END) END
  WHEN 'judged_mrr' THEN 1.0 / min(rank) FILTER (rank <= k AND shared > 0)
  WHEN 'temporal_coverage' THEN (max(CAST(rank <= k AND list_contains(dft, qft[1]) AS INTEGER)) + max(CAST(rank <= k AND list_contains(dft, qft[2]) AS INTEGER))) / 2.0
  ELSE count(*) FILTER (rank <= k AND shared > 0) * 1.0 / count(*) FILTER (rank <= k) END, 0.0), 5) AS score
  FROM (SELECT rel.*, k, sum(CAST(shared > 0 AS INTEGER)) OVER (PARTITION BY query_id, k ORDER BY rank) AS s, row_number() OVER (PARTITION BY query_id, k ORDER BY rank <= k DESC, sim DESC, rank) AS ideal FROM rel, ks),
  (SELECT unnest(['judged_precision', 'judged_recall', 'judged_ndcg', 'judged_mrr', 'temporal_coverage', 'temporal_relevance']) AS metric) GROUP BY query_id, metric, k"""


def _judgments(spark, d):
    """The rule judge's verdicts of each kind on each ranked document, joined by rank."""
    rows = S.ranked(spark, d).withColumns({"baseline": F.col("qft")[0], "comparison": F.col("qft")[1]})
    return evaluate.judged_run(evaluate.Inputs(rows.select("query_id"), rows), evaluate.Config())


@query(_JUDGED)
def judged_metrics(spark, d):
    return metrics.judged(_judgments(spark, d), KS)


@query(f"SELECT g.query_id, g.k, CASE WHEN c.score = 1.0 THEN g.score ELSE 0.0 END AS score FROM ({_SQL_GOLD['temporal_ndcg'].replace('(pow(2.0, 5 - priority) - 1)', 'CAST(priority <= 2 AS DOUBLE)')}) g JOIN ({_JUDGED}) c ON g.query_id = c.query_id AND g.k = c.k AND c.metric = 'temporal_coverage'")
def ndcg_full_coverage(spark, d):
    g = metrics.gold(S.run(spark, d).select("query_id", "doc_id", "rank"), S.qrels(spark, d, False), KS, ("temporal_ndcg",))
    return metrics.full_coverage_ndcg(g, metrics.judged(_judgments(spark, d), KS)).drop("metric")


_SQL_ANSWERS = "SELECT query_id, status, string_agg(CAST(year AS VARCHAR), ' ' ORDER BY rank) AS answer, list_sort(list_distinct(list(year))) AS aft FROM run GROUP BY 1, 2"


def _answers(spark, d):
    """An answer for each customer and order status: the years of its orders."""
    g = S.run(spark, d).groupBy("query_id", "status").agg(F.array_sort(F.collect_list(F.struct("rank", "year"))).alias("x"))
    return g.select("query_id", "status", F.array_join(F.transform("x", lambda x: x["year"].cast("string")), " ").alias("answer"))


@query(f"""SELECT query_id, status, round(len(list_intersect(aft, list_sort([1995 + query_id % 7, 1995 + (query_id + 3) % 7]))) / 2.0, 5) AS alignment,
  round(len(list_intersect(aft, range(1995, 1999))) * 1.0 / len(aft), 5) AS faithfulness, round(round(1 - len(list_intersect(aft, range(1995, 1999))) * 1.0 / len(aft), 6), 5) AS hallucination,
  round(CASE WHEN len(aft) < 3 THEN 1.0 ELSE round(2.0 / len(aft), 6) END, 5) AS coherence FROM ({_SQL_ANSWERS})""")
def generation_judgments(spark, d):
    rows = _answers(spark, d).withColumn("doc_id", F.col("status")).withColumn("qft", S.asked_years("query_id")).withColumn("context", F.lit("1995 1996 1997 1998"))
    kinds = ("alignment", "faithfulness", "hallucination", "coherence")
    said = judge.verdicts(rows, kinds, keys=("query_id", "status"))
    return said.select("query_id", "status", *(F.round(F.col(f"{kind}.{judge.CONTRACTS[kind].split()[0]}"), 5).alias(kind) for kind in kinds))


@query(f"SELECT query_id, status, round(len(list_intersect(aft, [1995 + query_id % 7, 1995 + (query_id + 3) % 7])) / 2.0, 5) AS score FROM ({_SQL_ANSWERS})")
def answer_year_recall(spark, d):
    return _answers(spark, d).select("query_id", "status", reasoning.answer_year_recall(years.document_years("answer"), S.asked_years("query_id")).alias("score"))


# Reasoning and composites


@query("""SELECT query_id, round(CASE WHEN n = 1 THEN 1.0 ELSE 1 - inv / (n * (n - 1) / 2.0) END, 6) AS score FROM (SELECT a.query_id, max(n) AS n, count(*) FILTER (a.rank < b.rank AND a.doc_id > b.doc_id) * 1.0 AS inv
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM run WHERE rank <= 10) a JOIN (SELECT * FROM run WHERE rank <= 10) b USING (query_id) GROUP BY 1)""")
def ordering_agreement(spark, d):
    """The first ten by price against the order of their ids."""
    g = S.run(spark, d).where("rank <= 10").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("x"))
    g = g.select("query_id", F.transform("x", lambda x: x["doc_id"]).alias("p")).withColumn("e", F.array_sort("p"))
    return g.select("query_id", F.round(reasoning.ordering_agreement(F.col("p"), F.col("e")), 6).alias("score"))


@query(f"SELECT a.query_id, round(coalesce(sum(CAST(a.aft = b.aft AS DOUBLE)) FILTER (a.status < b.status) / nullif(count(*) FILTER (a.status < b.status), 0), 0.0), 5) AS score FROM ({_SQL_ANSWERS}) a JOIN ({_SQL_ANSWERS}) b USING (query_id) GROUP BY 1")
def temporal_consistency(spark, d):
    return reasoning.consistency(_answers(spark, d).select("query_id", F.col("status").alias("sample_id"), years.years_1900("answer").alias("years")))


@query("SELECT doc_id, round((CAST(doc_id % 5 + 1 = 4 AS INTEGER) + CAST(doc_id % 3 + 1 = 3 AS INTEGER) + CAST(doc_id % 7 = 4 AS INTEGER)) / 2.0, 4) AS score, CAST((doc_id % 5 + 1) * 365 + (doc_id % 3 + 1) * 30 + CASE doc_id % 7 WHEN 4 THEN 1460 WHEN 6 THEN 1 ELSE 0 END AS DOUBLE) AS total_days, CASE WHEN doc_id % 7 = 4 THEN 1460.0 ELSE (doc_id % 5 + 1) * 365.0 END AS first_days FROM texts")
def duration_accuracy(spark, d):
    t = S.order_texts(spark, d)
    gold = F.array(text.duration_days(F.lit("4 years")), text.duration_days(F.lit("3 months")))
    return t.select("doc_id", text.duration_accuracy("text", gold).alias("score"), F.aggregate(text.durations("text"), F.lit(0.0), lambda a, x: a + x).alias("total_days"), text.duration_days("text").alias("first_days"))


_PARTS = "(SELECT query_id, avg(CAST(shared > 0 AS DOUBLE)) AS p, avg(sim) AS r, count(*) FILTER (priority = 1) * 1.0 / count(*) AS f, count(*) FILTER (status = 'F') * 1.0 / count(*) AS c FROM rel GROUP BY 1)"


def _sql_composite(name: str) -> str:
    (a, b, c, e), w = reasoning.PRESETS[name]
    f1 = "CASE WHEN {0} + {1} > 0 THEN 2 * {0} * {1} / ({0} + {1}) ELSE 0.0 END"
    layered = f1.format("rf", "gf") if w == 0.5 else f"(1 + {w * w}) * rf * gf / ({w * w} * rf + gf + 1e-10)"
    part = lambda wt, x: f"CASE WHEN {x} > 0 THEN {wt} / {x} ELSE 0.0 END"
    has = lambda wt, x: f"CASE WHEN {x} > 0 THEN {wt} ELSE 0.0 END"
    below = f"({part(a, 'p')} + {part(b, 'r')} + {part(c, 'f')} + {part(e, 'c')})"
    above = f"({has(a, 'p')} + {has(b, 'r')} + {has(c, 'f')} + {has(e, 'c')})"
    return f"SELECT query_id, '{name}' AS preset, round({a} * p + {b} * r + {c} * f + {e} * c + 1e-9, 4) AS weighted, round(CASE WHEN {below} > 0 THEN {above} / {below} ELSE 0.0 END + 1e-9, 4) AS harmonic, round({layered} + 1e-9, 4) AS f_score, round(rf + 1e-9, 4) AS retrieval_f1, round(gf + 1e-9, 4) AS generation_f1 FROM (SELECT *, {f1.format('p', 'r')} AS rf, {f1.format('f', 'c')} AS gf FROM {_PARTS})"


@query(" UNION ALL ".join(_sql_composite(n) for n in reasoning.PRESETS))
def composite_score(spark, d):
    g = S.ranked(spark, d).groupBy("query_id").agg(F.avg((sets.overlap("qft", "dft") > 0).cast("double")).alias("p"), F.avg(sets.jaccard("qft", "dft")).alias("r"), F.avg((F.col("priority") == 1).cast("double")).alias("f"), F.avg((F.col("status") == "F").cast("double")).alias("c"))
    made = {n: reasoning.composite(*map(F.col, "prfc"), weights=w, retrieval_weight=b, digits=None) for n, (w, b) in reasoning.PRESETS.items()}
    return metrics.union_all(*(g.select("query_id", F.lit(n).alias("preset"), *(F.round(x + 1e-9, 4).alias(k) for k, x in m.items())) for n, m in made.items()))


@query("SELECT query_id, round(count(*) FILTER (sim > 0) / sum(1.0 / sim) FILTER (sim > 0), 5) AS score FROM rel WHERE rank <= 10 GROUP BY 1")
def harmonic_mean(spark, d):
    g = S.ranked(spark, d).where("rank <= 10").groupBy("query_id").agg(F.collect_list(sets.jaccard("qft", "dft")).alias("s"))
    return g.select("query_id", reasoning.harmonic_mean(F.col("s")).alias("score"))


# Results

_SQL_SCORES = " UNION ALL ".join(f"SELECT query_id, '{m}' AS metric, k, score FROM ({s})" for m, s in _SQL_FOCUS.items() if m in ("temporal_precision", "temporal_mrr"))


def _scores(spark, d):
    return metrics.focus(S.ranked(spark, d), KS, ("temporal_precision", "temporal_mrr"))


@query(f"SELECT metric, k, round(round(avg(score), 5), 4) AS mean, round(round(stddev_pop(score), 5), 4) AS std, count(*) AS n FROM ({_SQL_SCORES}) GROUP BY 1, 2")
def result_summary(spark, d):
    a = results.aggregate(_scores(spark, d))
    return a.select("metric", "k", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query(f"SELECT c_mktsegment AS run_id, metric, round(avg(score), 3) AS mean, count(*) AS n FROM ({_SQL_SCORES}) JOIN customer ON c_custkey = query_id GROUP BY CUBE (1, 2)")
def leaderboard(spark, d):
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("run_id"))
    return results.leaderboard(_scores(spark, d).join(c, "query_id")).select("run_id", "metric", F.round("mean", 3).alias("mean"), "n")


@query(f"SELECT query_id, max(score) FILTER (metric = 'temporal_precision' AND k = 5) AS \"temporal_precision@5\", max(score) FILTER (metric = 'temporal_mrr' AND k = 10) AS \"temporal_mrr@10\" FROM ({_SQL_SCORES}) GROUP BY 1")
def wide_results(spark, d):
    return results.wide(_scores(spark, d), ["temporal_precision@5", "temporal_mrr@10"])


@query("""SELECT metric_name, count(*) AS n_ops, round(sum(latency_ms), 2) AS total_ms, round(avg(latency_ms), 2) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, CAST(sum(prompt_tokens) AS BIGINT) AS tokens,
  round(sum(prompt_tokens / 1000.0 * 0.0025), 4) AS cost_usd FROM ops GROUP BY ROLLUP (metric_name)""")
def efficiency_by_metric(spark, d):
    return efficiency.by_metric(efficiency.measured(S.operations(spark, d)))


# Collections, text, JSON


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'duration' WHEN doc_id % 4 = 2 THEN 'temporal_ordering' WHEN doc_id % 4 = 3 THEN 'change_over_time' ELSE 'specific_time' END AS focus,
  CASE WHEN doc_id % 3 = 0 THEN 'counting' WHEN doc_id % 3 = 1 THEN 'comparison' WHEN doc_id % 4 = 1 THEN 'duration' WHEN doc_id % 4 = 2 THEN 'temporal_ordering' ELSE 'specific_time' END AS typed,
  CASE WHEN doc_id % 2 = 0 THEN 'order' ELSE 'change_over_time' END AS reasoning, doc_id % 4 = 3 AS cross_period, CASE WHEN doc_id % 4 = 3 THEN '1995' ELSE '' END AS baseline, CASE WHEN doc_id % 4 = 3 THEN '1999' ELSE '' END AS comparison FROM texts""")
def label_inference(spark, d):
    k = F.col("doc_id")
    q = F.element_at(F.array(*map(F.lit, ("When did it ship?", "How long was it?", "Was it before that?", "Has it changed?"))), (k % 4 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("Counting"), F.lit("comparison"), F.lit("other")), (k % 3 + 1).cast("int"))
    t = S.order_texts(spark, d).select("doc_id", q.alias("q"), kind.alias("kind"), F.when(k % 2 == 0, "Ordering").otherwise("compare").alias("r"))
    cross = text.is_cross_period(F.lit("x"), "q")
    first, last = text.period_anchors(cross, F.array(F.lit("1995"), F.lit("1997"), F.lit("1999")))
    return t.select("doc_id", text.question_focus("q").alias("focus"), text.typed_question_focus("kind", "q").alias("typed"), text.reasoning_focus("r").alias("reasoning"), cross.alias("cross_period"), first.alias("baseline"), last.alias("comparison"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def loose_json(spark, d):
    e = S.table(spark, d, "events")
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" Bye."))).otherwise(F.lit("no object here"))
    return e.select("event_id", text.json_answer(answer, "k long")["k"].alias("k"))


@query("SELECT doc_id, substr('[Document 1]' || chr(10) || text || chr(10) || chr(10) || '[Document 2]' || chr(10) || 'x', 1, 60) AS context, substr(text, 1, 20) AS cut, 'find: ' || text AS asked, (length(text) // 4) AS tokens, round((length(text) // 4) / 1000.0 * 0.0025, 8) AS cost FROM texts")
def text_helpers(spark, d):
    t = S.order_texts(spark, d)
    n = text.tokens_of_chars(F.length("text"))
    return t.select("doc_id", text.numbered_context(F.array("text", F.lit("x")), 60).alias("context"), F.substring("text", 1, 20).alias("cut"), text.instructed("find: ", "text").alias("asked"), n.alias("tokens"), F.round(text.cost(F.lit("m"), n, F.lit(0)), 8).alias("cost"))


@query("SELECT doc_id, CASE WHEN doc_id BETWEEN 1900 AND 2099 THEN CAST(doc_id AS VARCHAR) ELSE CAST(oy AS VARCHAR) END AS text, CAST(CASE WHEN doc_id BETWEEN 1900 AND 2099 THEN 6 ELSE length('Order ' || doc_id || ' of ') END AS INTEGER) AS start_pos FROM texts")
def first_year_span(spark, d):
    s = spans.spans(S.order_texts(spark, d), "doc_id", "text").where("kind = 'year'")
    return s.groupBy("doc_id").agg(F.min(F.struct("start_pos", "text")).alias("x")).select("doc_id", F.col("x.text").alias("text"), F.col("x.start_pos").alias("start_pos"))


@query("SELECT c_custkey AS query_id, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def filter_equal(spark, d):
    return datasets.where_equal(S.table(spark, d, "customer"), c_mktsegment="BUILDING", c_nationkey=3).select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("segment"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS query_id, c_name AS query, '' AS baseline_anchor, false AS is_cross_period, c_mktsegment AS segment FROM customer")
def query_collection(spark, d):
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("question"), "c_mktsegment", "c_acctbal")
    q = datasets.queries(c)
    return datasets.flat(q, "c_mktsegment").select("query_id", "query", "baseline_anchor", "is_cross_period", F.col("c_mktsegment").alias("segment"))


@query("SELECT c_custkey AS query_id, c_name FROM customer ORDER BY md5('42/' || c_custkey), c_custkey LIMIT 100")
def seeded_sample(spark, d):
    return datasets.sample(S.table(spark, d, "customer").withColumnRenamed("c_custkey", "query_id"), 100).select("query_id", "c_name")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN len({0}) = 0 THEN 'none' ELSE 'year' END AS granularity, array_to_string({0}, ',') AS anchors, CAST(len({0}) AS INTEGER) AS steps, CAST(1 AS INTEGER) AS n_gold FROM texts WHERE doc_id % 2 <> 0".format(f"list_sort(list_distinct(list_concat(list_concat({_SQL_YEARS}, {_SQL_PHRASE}), {_SQL_RELATIVE})))"))
def guidance_resume(spark, d):
    """Annotate the orders' texts; those with even ids are done already."""
    t = S.order_texts(spark, d)
    q = t.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("query"), F.array(F.col("doc_id").cast("string")).alias("gold_ids"), F.array().cast("array<string>").alias("negative_ids"))
    todo = guidance.pending(q, t.where("doc_id % 2 = 0").select("doc_id").withColumnRenamed("doc_id", "id"))
    a = guidance.annotate(todo, t, NOW)
    return a.select("id", F.col("query_guidance.expected_granularity").alias("granularity"), F.array_join("query_guidance.key_time_anchors", ",").alias("anchors"), F.size("query_guidance.retrieval_plan").alias("steps"), F.size("gold_passage_annotations").alias("n_gold"))


_MOVED = "[y + 1 FOR y IN qft]"


@query(f"SELECT case_id, expected, CASE expected WHEN 'lower' THEN s1 < s0 WHEN 'higher' THEN s1 > s0 ELSE abs(s1 - s0) < 1e-6 END AS passed FROM (SELECT query_id AS case_id, ['lower', 'higher', 'same'][query_id % 3 + 1] AS expected, round(sum(sim), 6) AS s0, round(sum(len(list_intersect({_MOVED}, dft)) * 1.0 / len(list_distinct(list_concat({_MOVED}, dft)))), 6) AS s1 FROM rel GROUP BY 1)")
def perturbation_check(spark, d):
    """Moving every year of a query by one: the sum of its similarities with what it asked for falls, rises or stays."""
    r = S.ranked(spark, d)
    score = lambda q: r.groupBy(F.col("query_id").alias("case_id")).agg(F.round(F.sum(sets.jaccard(q, F.col("dft"))), 6).alias("score"))
    moved = F.transform("qft", lambda y: y + 1)
    expected = F.element_at(F.array(*map(F.lit, ("lower", "higher", "same"))), (F.col("case_id") % 3 + 1).cast("int"))
    return meta.validate(score(F.col("qft")).withColumn("expected", expected), score(moved)).select("case_id", "expected", "passed")


_HASH = "CAST(('0x' || substr(md5('0/' || {}), 1, 8)) AS BIGINT)"
_SCRAMBLED = f"array_to_string(list_transform(string_split(regexp_replace(text, '\\b(19[0-9]{{2}}|20[0-9]{{2}})\\b', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda p: CASE WHEN regexp_full_match(p, '19[0-9]{{2}}|20[0-9]{{2}}') THEN CAST(CAST(p AS INTEGER) + {_HASH.format('text')} % 20 + 3 AS VARCHAR) ELSE p END), '')"
_SHUFFLED = "array_to_string(list_transform(list_sort(list_transform(string_split(text, '. '), lambda s: {'h': md5('0/' || s), 's': s})), lambda x: x.s), '. ')"


@query(f"SELECT doc_id, {_SCRAMBLED} AS scrambled, {_SHUFFLED} AS shuffled, text || ' ' || [{', '.join(repr(x) for x in meta.STATEMENTS)}][{_HASH.format('text')} % 3 + 1] AS injected FROM texts")
def perturbed_texts(spark, d):
    t = S.order_texts(spark, d)
    return t.select("doc_id", meta.scramble_years(F.col("text")).alias("scrambled"), meta.shuffle_events(F.col("text")).alias("shuffled"), meta.inject_hallucination(F.col("text")).alias("injected"))


# Statistics over time


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, metric_name, count(*) AS n_ops, round(sum(latency_ms), 4) AS sum_ms, max(latency_ms) AS max_ms FROM ops GROUP BY 1, 2")
def windowed_operations(spark, d):
    w = stream_ops.windowed(S.operations(spark, d), lateness=None)
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "metric_name", "n_ops", F.round("sum_ms", 4).alias("sum_ms"), "max_ms")


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n_ops, round(sum(latency_ms), 4) AS sum_ms FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, op_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, op_id) >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS n FROM ops)) GROUP BY user_id, s""")
def operation_sessions(spark, d):
    s = stream_ops.sessions(S.operations(spark, d), lateness=None)
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n_ops", F.round("sum_ms", 4).alias("sum_ms"))


# The front door

_EVALUATED = ["focus_temporal_precision", "focus_temporal_year_recall", "gold_temporal_recall", "gold_temporal_mrr", "temporal_relevance", "temporal_consistency", "temporal_faithfulness"]


def _inputs(spark, d, run=None):
    """All customers as queries, also those without orders."""
    queries = S.table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    answers = _answers(spark, d).select("query_id", F.col("status").alias("sample_id"), years.document_years("answer").alias("years"))
    return evaluate.Inputs(queries, S.ranked(spark, d) if run is None else run, S.qrels(spark, d, False), answers)


def _sql_evaluated(where: str = "true") -> str:
    focus = " UNION ALL ".join(f"SELECT query_id, 'focus_{m}' AS metric, k, score FROM ({_SQL_FOCUS[m]})" for m in ("temporal_precision", "temporal_year_recall"))
    gold = " UNION ALL ".join(f"SELECT query_id, 'gold_{m}' AS metric, k, score FROM ({_SQL_GOLD[m]})" for m in ("temporal_recall", "temporal_mrr"))
    judged = f"SELECT query_id, metric, k, score FROM ({_JUDGED}) WHERE metric = 'temporal_relevance'"
    same = f"SELECT query_id, 'temporal_consistency' AS metric, 0 AS k, score FROM ({ORACLE['temporal_consistency'].removeprefix(f'WITH {S.SQL} ')})"
    grid = "SELECT c_custkey AS query_id, metric, k, error FROM customer, (SELECT unnest(['focus_temporal_precision', 'focus_temporal_year_recall', 'gold_temporal_recall', 'gold_temporal_mrr', 'temporal_relevance']) AS metric, unnest([[5, 10, 20], [5, 10, 20], [5, 10, 20], [5, 10, 20], [5, 10, 20]]) AS kk, NULL AS error), ks WHERE list_contains(kk, k) UNION ALL SELECT c_custkey, unnest(['temporal_consistency', 'temporal_faithfulness']), 0, unnest([NULL, 'lacks answer_texts.answer']) FROM customer"
    return f"SELECT g.query_id, g.metric, CASE WHEN g.k > 0 THEN CAST(g.k AS INTEGER) END AS k, CASE WHEN g.k > 0 THEN coalesce(f.score, 0.0) ELSE f.score END AS score, CAST(g.error AS VARCHAR) AS error FROM ({grid}) g LEFT JOIN ({focus} UNION ALL {gold} UNION ALL {judged} UNION ALL {same}) f USING (query_id, metric, k)"


@query(_sql_evaluated())
def evaluate_all(spark, d):
    """Seven metrics of four families at all cut-offs; one lacks its table and has errors; customers without orders score 0."""
    return evaluate.evaluate(_inputs(spark, d), _EVALUATED, KS)


@query(f"SELECT run_id, query_id, k, score FROM (SELECT 'price' AS run_id, query_id, k, score FROM ({_SQL_GOLD['temporal_mrr']}) UNION ALL SELECT 'id', query_id, k, round(coalesce(1.0 / min(r) FILTER (priority <= 2 AND r <= k), 0.0), 5) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS r FROM run), ks GROUP BY query_id, k)")
def run_suite(spark, d):
    """Two runs of the same queries: by price, and by id."""
    o = S.run(spark, d)
    by_id = o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    asked = o.select("query_id").distinct()
    runs = {name: evaluate.Inputs(asked, r.select("query_id", "doc_id", "rank"), S.qrels(spark, d, False)) for name, r in (("price", o), ("id", by_id))}
    return evaluate.run_suite(runs, ["gold_temporal_mrr"], KS).select("run_id", "query_id", "k", "score")


@query(f"SELECT query_id, round(0.25 * p + 0.25 * r, 4) AS weighted FROM (SELECT query_id, max(score) FILTER (metric = 'p') AS p, max(score) FILTER (metric = 'r') AS r FROM (SELECT query_id, 'p' AS metric, k, score FROM ({_SQL_FOCUS['temporal_precision']}) UNION ALL SELECT query_id, 'r', k, score FROM ({_SQL_GOLD['temporal_recall']})) WHERE k = 5 GROUP BY 1)")
def composite_by_name(spark, d):
    """Components by name at their lowest cut-off; missing ones are 0."""
    i = _inputs(spark, d)
    scores = evaluate.evaluate(evaluate.Inputs(i.run.select("query_id"), i.run, i.qrels), ["focus_temporal_precision", "gold_temporal_recall"], (10, 5))
    return evaluate.composite(scores, "focus_temporal_precision", "gold_temporal_recall", "temporal_faithfulness", "temporal_coherence").select("query_id", "weighted")


@query(f"""SELECT query_id, status, CAST(CASE WHEN list_distinct(regexp_extract_all(answer, '[0-9]+')) IS NULL THEN 1 ELSE o END AS DOUBLE) AS ordering,
  round(len(list_intersect(aft, list_sort([1995 + query_id % 7, 1995 + (query_id + 3) % 7]))) / 2.0, 5) AS duration, (CAST(list_contains(aft, 1996) AS INTEGER) + CAST(list_contains(aft, 1998) AS INTEGER)) / 2.0 AS cross_period,
  array_to_string(list_sort(list_distinct([y // 5 * 5 FOR y IN aft])), ',') AS periods, array_to_string(aft, ',') AS years
  FROM (SELECT *, (SELECT CAST(bool_and(f >= g) AS INTEGER) FROM (SELECT f, coalesce(lag(f) OVER (ORDER BY y), 0) AS g FROM (SELECT y, list_position(string_split(answer, ' '), CAST(y AS VARCHAR)) AS f FROM (SELECT unnest(aft) AS y)))) AS o FROM ({_SQL_ANSWERS}))""")
def reasoning_judgments(spark, d):
    """Event order, duration and cross-period verdicts on answers, five-year periods and implied years."""
    rows = _answers(spark, d).withColumns({"qft": S.asked_years("query_id"), "baseline": F.lit(1996), "comparison": F.lit(1998), "doc": F.col("answer")})
    said = judge.verdicts(rows, ("ordering", "duration", "cross_period", "periods", "years"), keys=("query_id", "status"))
    return said.select("query_id", "status", "ordering.ordering_score", F.round("duration.accuracy_score", 5).alias("duration"), F.col("cross_period.cross_period_score").alias("cross_period"), shown("periods.unique_years").alias("periods"), shown("years.all_years").alias("years")).withColumnRenamed("ordering_score", "ordering")
