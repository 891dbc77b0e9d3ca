import json
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from annalist.operators import efficiency, guidance, judge, meta, metrics, ranking
from annalist.sources import datasets
from annalist.streaming import ops


def test_top_k_and_exclusion(spark):
    s = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 2.0), ("q", "c", 2.0)], "query_id string, doc_id string, score double")
    assert [(r["doc_id"], r["rank"]) for r in ranking.top_k(s, 2).orderBy("rank").collect()] == [("b", 1), ("c", 2)]
    x = spark.createDataFrame([("q", "a"), ("q", "N/A")], "query_id string, doc_id string")
    assert ranking.exclude(s, x).count() == 2


def test_bm25_prefers_rare_terms(spark):
    d = spark.createDataFrame([("a", "gold coin gold"), ("b", "coin coin coin"), ("c", None)], "doc_id string, text string")
    q = spark.createDataFrame([("q", "gold coin")], "query_id string, query string")
    assert [r["doc_id"] for r in ranking.bm25(d, q).orderBy("rank").collect()] == ["a", "b"]


def test_ranking_reads_all_languages(spark):
    from annalist.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    bag = lambda t: Counter(re.findall("[a-z0-9]+", (t or "").lower()))
    docs = {i: bag(r["text"]) for i, r in rows.items()}
    asked = {r["item_id"]: bag(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    size = {i: b.total() for i, b in docs.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(w for b in docs.values() for w in b)
    idf = {w: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    weigh = lambda w, n, length: idf[w] * n / (n + 0.9 * (1 - 0.4 + 0.4 * length / mean))
    score = {
        "keyword_overlap": lambda q, b, length: float(len(q.keys() & b.keys())),
        "bm25": lambda q, b, length: sum(weigh(w, b[w], length) * weigh(w, q[w], q.total()) for w in q.keys() & b.keys()),
    }
    for name, f in score.items():
        got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in QUERIES[name](spark, d).collect()}
        n = 0
        for q, words in asked.items():
            scores = {i: f(words, b, size[i]) for i, b in docs.items() if words.keys() & b.keys()}
            best = sorted(scores.values(), reverse=True)[:10]
            n += len(best)
            for k, x in enumerate(best, 1):
                doc, s = got[q, k]
                assert s == pytest.approx(x, abs=2e-6) and s == pytest.approx(scores[doc], abs=2e-6)
        assert len(got) == n and {rows[i]["lang"] for i, _ in got.values()} > {"en"}


def test_cosine(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "doc_id long, embedding array<float>")
    q = e.where("doc_id = 1").withColumnRenamed("doc_id", "query_id")
    assert [(r["doc_id"], r["score"]) for r in ranking.cosine(q, e, 4).orderBy("rank").collect()] == [(1, 1.0), (4, 0.707107), (2, 0.0), (3, 0.0)]


def test_embedding_cache(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    cached = ranking.embed(d.where("doc_id = 1"))
    assert [r["doc_id"] for r in ranking.missing(d, cached).collect()] == [2]
    changed = d.withColumn("text", F.concat("text", F.lit("!")))
    assert ranking.missing(changed, cached).count() == 2


def test_judge_contract_and_resume(spark):
    rows = spark.createDataFrame([("q", "a", "in 1999", "it was 1999"), ("q", "b", "in 1999", "no")], "query_id string, doc_id string, query string, doc string")
    j = judge.judge(rows, "precision")
    assert {r["doc_id"]: r["verdict"] for r in judge.parsed(j, "precision").collect()} == {"a": 1, "b": 0}
    assert judge.resume(rows, j.where("doc_id = 'a'"), "precision").count() == 1
    with pytest.raises(ValueError, match="no judge named"):
        judge.get_judge("nobody")


def test_judges_get_whole_texts(spark):
    long = "1999 " * 1000
    rows = spark.createDataFrame([("q", "a", [2001], long + "2001", long + "2001", long + "2001")], "query_id string, doc_id string, qft array<int>, doc string, answer string, context string")
    value = lambda j, kind: judge.parsed(j, kind).first()[judge.CONTRACTS[kind].split()[0]]
    none = judge.judge(rows, "precision").where("false")
    for kind, x in {"precision": 1, "alignment": 1.0, "faithfulness": 1.0}.items():
        assert value(judge.judge(rows, kind), kind) == value(judge.resume(rows, none, kind), kind) == x
    assert value(judge.judge(rows.withColumn("context", F.lit("1999")), "faithfulness"), "faithfulness") == 0.5

    class Short(judge.RuleJudge):
        name = "short"
        limits = {"doc": 2000, "context": 8000}

    for j in (judge.judge, lambda rows, kind, by: judge.resume(rows, none, kind, by)):
        assert value(j(rows, "precision", Short()), "precision") == 0
        assert value(j(rows, "alignment", Short()), "alignment") == value(j(rows, "faithfulness", Short()), "faithfulness") == 1.0


def test_hot_answers_are_judged_whole(spark, tmp_path):
    from annalist.plans.queries import QUERIES

    year = F.when(F.col("id") < 10, 1998).otherwise(1995)  # the least prices, so the last years of the answer
    o = spark.range(1000).select(F.lit(3).cast("long").alias("o_custkey"), F.col("id").alias("o_orderkey"), F.col("id").cast("double").alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority"), F.make_date(year, F.lit(1), F.lit(1)).alias("o_orderdate"), F.lit("O").alias("o_orderstatus"))
    o.write.parquet(str(tmp_path / "orders.parquet"))
    r = QUERIES["generation_judgments"](spark, str(tmp_path)).first()
    assert (r["alignment"], r["faithfulness"], r["coherence"]) == (0.5, 1.0, 1.0)


def test_retries():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("rate limit")
        return "{}"

    assert judge.with_retries(call, sleep=lambda s: None) == "{}" and len(calls) == 3
    with pytest.raises(KeyError):
        judge.with_retries(lambda: {}["x"], sleep=lambda s: None)


def test_judge_errors_are_kept(spark):
    class Bad:
        name = "bad"

        def answer(self, kind, row):
            raise RuntimeError("broken")

    rows = spark.createDataFrame([("q", "a")], "query_id string, doc_id string")
    r = judge.judge(rows, "faithfulness", Bad()).first()
    assert r["payload"] is None and "broken" in r["error"]


def test_efficiency(spark):
    o = spark.createDataFrame([("p", 1.0, 100, 50), ("p", 3.0, 200, 100), ("r", 2.0, 150, 75)], "metric_name string, latency_ms double, prompt_tokens int, completion_tokens int")
    got = {r["metric_name"]: (r["n_ops"], r["tokens"]) for r in efficiency.by_metric(efficiency.measured(o)).collect()}
    assert got == {"p": (2, 450), "r": (1, 225), None: (3, 675)}


def test_guidance_resume(spark, tmp_path):
    q = spark.createDataFrame([("1", "What happened in 1999?", ["x", "blank"], []), ("2", "Who?", [], ["gone"])], "id string, query string, gold_ids array<string>, negative_ids array<string>")
    p = spark.createDataFrame([("x", "In 1998"), ("blank", " ")], "doc_id string, text string")
    out = str(tmp_path / "out")
    assert guidance.label_batch(q.limit(1), p, out, 2026) == 1
    assert guidance.label_batch(q, p, out, 2026) == 1
    assert guidance.label_batch(q, p, out, 2026) == 0
    assert spark.read.json(out).count() == 2


def test_meta(spark):
    t = spark.createDataFrame([("It was 1999. Then 2001. End",)], "t string")
    moved = t.select(meta.scramble_years(F.col("t"))).first()[0]
    assert "1999" not in moved and moved.startswith("It was 20")
    assert sorted(t.select(meta.shuffle_events(F.col("t"))).first()[0].split(". ")) == sorted("It was 1999. Then 2001. End".split(". "))
    assert t.select(meta.inject_hallucination(F.col("t"))).first()[0].removeprefix("It was 1999. Then 2001. End ") in meta.STATEMENTS
    o = spark.createDataFrame([(1, "lower", 0.5), (2, "same", 0.5), (3, "higher", None)], "case_id int, expected string, score double")
    p = spark.createDataFrame([(1, 0.4), (2, 0.5), (3, 0.9)], "case_id int, score double")
    assert tuple(meta.report(meta.validate(o, p)).first()) == (3, 2, 1)


def test_collections(spark, tmp_path):
    f = tmp_path / "q.jsonl"
    f.write_text('{"id": "1", "query": "a"}\nbroken\n{"qid": "2", "query": "b"}\n')
    assert datasets.read_query_lines(spark, str(f)).count() == 2
    (tmp_path / "c" / "d").mkdir(parents=True)
    (tmp_path / "c" / "d" / "x.txt").write_text("hello world")
    assert [tuple(r) for r in datasets.read_corpus(spark, str(tmp_path / "c"), 5).collect()] == [("d/x", "hello")]
    assert datasets.read_reasoning_tasks(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="domain"):
        datasets.read_domain_queries(spark, str(tmp_path), "nowhere")
    q = datasets.queries(spark.createDataFrame([("7", "what?", "x")], "id string, question string, extra string"))
    assert q.first()["metadata"] == {"extra": "x"}
    assert datasets.sample(q, 5).count() == 1 and datasets.where_equal(q, gold_answer=None).count() == 1


def test_domain_fallback(spark, tmp_path):
    d = spark.createDataFrame([("1", "prices since 2017", ["2017", "2024"])], "id string, query string, key_time_anchors array<string>")
    d.write.parquet(str(tmp_path / "examples" / "law"))
    r = datasets.read_domain_queries(spark, str(tmp_path), "law").first()
    assert (r["is_cross_period"], r["baseline_anchor"], r["comparison_anchor"]) == (True, "2017", "2024")


def test_stream_equals_table(spark, tmp_path):
    e = spark.createDataFrame([(i, f"2024-01-01 0{i % 4}:10:00", "m", float(i)) for i in range(12)], "op_id int, ts string, metric_name string, latency_ms double").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    s = ops.windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), lateness="10 hours")
    q = s.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, ops.windowed(e, lateness=None).collect()))


def test_contract_has_sql_for_queries():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) > 45
    assert json.dumps(sorted(o))


def test_evaluate(spark):
    from annalist.operators import evaluate

    queries = spark.createDataFrame([(1, "change_over_time", 2000, 2001), (2, "specific_time", 2000, 2001), (3, "specific_time", 2000, 2001)], "query_id long, temporal_focus string, baseline int, comparison int")
    run = spark.createDataFrame([(1, "a", 1, [2000], [2000]), (1, "b", 2, [2000], [2001]), (2, "a", 1, [2000], [2000])], "query_id long, doc_id string, rank int, qft array<int>, dft array<int>")
    qrels = spark.createDataFrame([(1, "a", 1.0), (3, "z", 1.0)], "query_id long, doc_id string, gain double")
    i = evaluate.Inputs(queries, run, qrels)
    evaluate.register_metric(evaluate.Metric("broken", "retrieval", lambda *x: run.select("nothing")))
    got = {(r["query_id"], r["metric"], r["k"]): (r["score"], r["error"]) for r in evaluate.evaluate(i, ["focus_temporal_precision", "gold_temporal_recall", "temporal_coverage", "temporal_faithfulness", "broken"], (1, 5)).collect()}
    assert len(got) == 3 * (2 + 2 + 2 + 1 + 2)
    assert got[1, "focus_temporal_precision", 5] == (0.5, None) and got[3, "focus_temporal_precision", 5] == (0.0, None)
    assert got[1, "gold_temporal_recall", 1] == (1.0, None) and got[3, "gold_temporal_recall", 5] == (0.0, None)
    assert got[1, "temporal_coverage", 5][0] == 1.0 and got[2, "temporal_coverage", 5][0] == 0.0  # not about change
    assert got[1, "temporal_faithfulness", None] == (None, "lacks answer_texts.answer")
    assert got[1, "broken", 1][0] is None and "nothing" in got[1, "broken", 1][1]
    del evaluate.METRICS["broken"]
    with pytest.raises(ValueError, match="no metric named"):
        evaluate.get_metric("nope")
    assert "gold_temporal_mrr" in evaluate.list_metrics(requires_gold=True) and evaluate.list_metrics(higher_is_better=False) == ["temporal_hallucination"]
    c = evaluate.Config(k_values=[3], judge="x")
    assert evaluate.Config.from_dict(c.to_dict() | {"unknown": 1}) == c


def test_gold_scores_queries_without_results(spark):
    run = spark.createDataFrame([(1, "a", 1)], "query_id long, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "query_id long, doc_id string, gain double")
    got = {(r["query_id"], r["metric"]): r["score"] for r in metrics.gold(run, qrels, (5,)).collect()}
    assert {m: s for (q, m), s in got.items() if q == 2} == {"temporal_recall": 0.0, "temporal_ndcg": 0.0, "temporal_mrr": 0.0}


def test_rule_judge_by_columns(spark):
    """The same verdicts in the JVM and row by row."""
    from annalist.functions.text import json_answer

    rows = [(1, "a", "in 1990 and 2001", "1990 1995", "2001 then 1999, 2001", "1999", 1990, 2001), (2, "b", None, "", "", None, None, 1999), (3, "c", "1999", "no", "1994 1995", "1994", 1994, 1995)]
    d = spark.createDataFrame(rows, "query_id long, doc_id string, query string, doc string, answer string, context string, baseline int, comparison int")
    for kind, contract in judge.CONTRACTS.items():
        by_row = [judge.RuleJudge().answer(kind, dict(zip(d.columns, r, strict=True))) for r in rows]
        want = [r["x"].asDict() for r in spark.createDataFrame([(x,) for x in by_row], "j string").select(json_answer("j", contract).alias("x")).collect()]
        got = [r["x"].asDict() for r in judge.verdicts(d, (kind,)).orderBy("query_id").select(F.col(kind).cast(f"struct<{', '.join(f.replace(' ', ':', 1) for f in contract.split(', '))}>").alias("x")).collect()]
        assert got == want, kind


def test_taggers_and_retrievers(spark):
    from annalist.functions import taggers

    d = spark.createDataFrame([(1, "the 1990s"), (2, "boom"), (3, None)], "id long, t string")

    def tag(texts):
        if "boom" in texts:
            raise ValueError
        return [[len(t), len(t)] for t in texts]

    taggers.register_tagger("lengths", tag)
    assert {r["id"]: r["years"] for r in taggers.tagged(d, "id", "t", "lengths").collect()} == {1: [9], 2: [], 3: [0]}
    assert {r["id"]: len(r["years"]) for r in taggers.tagged(d, "id", "t").collect()} == {1: 10, 2: 0, 3: 0}
    assert ranking.list_retrievers() == ["bm25", "cosine", "keyword"]
    with pytest.raises(ValueError, match="no retriever"):
        ranking.get_retriever("x")


def test_cosine_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = np.round(rng.standard_normal((60, 4)), 1)
    v[7] = 0
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>").repartition(5)
    q = d.where("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), 1)
    s = np.round(unit[:9] @ unit.T, 6)
    want = {(i, int(j)) for i in range(9) for j in np.lexsort((np.arange(60), -s[i]))[:7]}
    assert {(r["query_id"], r["doc_id"]) for r in ranking.cosine(q, d, 7).collect()} == want


def test_all_phrases(spark):
    from annalist.functions import years

    for p, (a, b) in years.PHRASES.items():
        got = spark.createDataFrame([(f"After {p.upper()}, and x{p}",)], "t string").select(years.phrase_years(F.col("t")).alias("y")).first()["y"]
        assert got == list(range(a, b + 1)), p
    for p, (a, b) in years.RELATIVE.items():
        got = spark.createDataFrame([(p.replace(" ", "  "),)], "t string").select(years.relative_years(F.col("t"), 2000).alias("y")).first()["y"]
        assert got == list(range(2000 + a, 2001 + b)), p
    t = spark.createDataFrame([("world war i and world war ii, past 3 years",)], "t string")
    assert t.select(years.phrase_years(F.col("t")).alias("y")).first()["y"] == list(range(1939, 1946))
    assert t.select(years.relative_years(F.col("t"), 2000).alias("y")).first()["y"] == [1997, 1998, 1999, 2000]
