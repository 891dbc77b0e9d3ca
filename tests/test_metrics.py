import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist.operators import metrics, reasoning, results


def ranked(spark, q, docs):
    return spark.createDataFrame([(1, str(i), i + 1, q, d) for i, d in enumerate(docs)], "query_id int, doc_id string, rank int, qft array<int>, dft array<int>")


def scores(df):
    return {(r["metric"], r["k"]): r["score"] for r in df.collect()}


def test_focus(spark):
    s = scores(metrics.focus(ranked(spark, [2020, 2021], [[2020], [2019], [2021]]), (3, 10)))
    assert s["temporal_precision", 3] == s["temporal_precision", 10] == 0.66667
    assert s["temporal_mrr", 3] == 1.0 and s["temporal_recall", 3] == 1.0
    s = scores(metrics.focus(ranked(spark, [2020], [[2020], [2020], [1999], [2020], [2020]]), (3,)))
    assert s["temporal_precision", 3] == 0.66667 and s["temporal_map", 3] == 1.0
    s = scores(metrics.focus(ranked(spark, [2020], [[2020], [1], [2020], [2]]), (4,)))
    assert s["temporal_map", 4] == 0.83333


def test_recall_with_total_and_scope(spark):
    r = ranked(spark, [2020], [[2020], [2019]]).withColumn("total", F.lit(3)).withColumn("scope", F.lit(10))
    s = scores(metrics.focus(r, (2,), total_relevant="total", scope="scope"))
    assert s["temporal_recall", 2] == 0.33333 and s["temporal_diversity", 2] == 0.2


def test_empty_years(spark):
    s = scores(metrics.focus(ranked(spark, [], [[], []]), (5,)))
    assert set(s.values()) == {0.0}


def test_gold(spark):
    run = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(["b", "a", "c"])], "query_id string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", "a", 4.0), ("q", "b", 2.0)], "query_id string, doc_id string, gain double")
    s = scores(metrics.gold(run, rel, (3,)))
    assert s["temporal_ndcg", 3] == 0.73783 and s["temporal_recall", 3] == 1.0 and s["temporal_mrr", 3] == 1.0


def test_gold_at_ten_and_duplicates(spark):
    run = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 11)] + [("p", "a", 1), ("p", "a", 2)], "query_id string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", "d10", 1.0), ("p", "a", 1.0)], "query_id string, doc_id string, gain double")
    got = {(r["query_id"], r["metric"]): r["score"] for r in metrics.gold(run, rel, (10,)).collect()}
    assert got["q", "temporal_ndcg"] == 0.28906 and got["p", "temporal_ndcg"] == 1.0


def test_focus_ndcg_against_hand(spark):
    docs, q = [[2021], [2020, 2021], [1990]], [2020, 2021]
    gain = [4 * len(set(d) & set(q)) / len(set(d) | set(q)) for d in docs]
    dcg = lambda g: sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(g))
    s = scores(metrics.focus(ranked(spark, q, docs), (3,), ("temporal_ndcg",)))
    assert s["temporal_ndcg", 3] == pytest.approx(dcg(gain) / dcg(sorted(gain, reverse=True)), abs=1e-5)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(2000, 2004), max_size=3), min_size=1, max_size=8))
def test_ranges(spark, docs):
    s = scores(metrics.focus(ranked(spark, [2000, 2003], docs), (2, 5)))
    assert all(0 <= x <= 1 for x in s.values())
    assert s["temporal_recall", 2] <= s["temporal_recall", 5]


def test_plan_has_no_python(spark):
    plan = metrics.focus(ranked(spark, [2020], [[2020]]), (5,))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") <= 1


def test_ordering(spark):
    f = lambda p, e: spark.range(1).select(reasoning.ordering_agreement(F.array(*map(F.lit, p)), F.array(*map(F.lit, e)))).first()[0]
    assert [f(list(p), list(e)) for p, e in (("ABC", "ABC"), ("CBA", "ABC"), ("A", "A"), ("AXB", "AB"))] == [1.0, 0.0, 1.0, 1.0]
    assert f(list("BAC"), list("ABC")) == pytest.approx(2 / 3) and f(list("BXA"), list("AB")) == pytest.approx(2 / 3)


def test_consistency(spark):
    a = spark.createDataFrame([(1, i, [y]) for i, y in enumerate((2007, 2007, 2007, 2008))] + [(2, 0, [1])], "query_id int, sample_id int, years array<int>")
    assert {r[0]: r[1] for r in reasoning.consistency(a).collect()} == {1: 0.5, 2: 0.0}


def test_composite(spark):
    f = lambda preset: spark.range(1).select(*(x.alias(k) for k, x in reasoning.composite(*map(F.lit, (0.8, 0.7, 0.9, 0.85)), *reasoning.PRESETS[preset]).items())).first().asDict()
    assert f("balanced") == {"weighted": 0.8125, "harmonic": 0.8055, "f_score": 0.8055, "retrieval_f1": 0.7467, "generation_f1": 0.8743}
    assert (f("retrieval")["weighted"], f("retrieval")["harmonic"], f("retrieval")["f_score"]) == (0.79, 0.7829, 0.7843)
    assert (f("generation")["weighted"], f("generation")["harmonic"], f("generation")["f_score"]) == (0.84, 0.8339, 0.7558)
    h = lambda *x: spark.range(1).select(reasoning.harmonic_mean(F.array(*map(F.lit, x)).cast("array<double>"))).first()[0]
    assert h(0.5, 1.0) == 0.66667 and h(0.0, 0.8) == 0.8 and h() is None and h(0.5, float("nan"), 0.5) == 0.5


def test_results(spark):
    s = spark.createDataFrame([("a", "m", 5, 0.6), ("b", "m", 5, 0.8), ("c", "m", 5, None), ("d", "x", 5, None)], "query_id string, metric string, k int, score double")
    assert [tuple(r) for r in results.aggregate(s).collect()] == [("m", 5, 0.7, 0.1, 2)]
    assert "m@5: 0.70000" in results.summary(s)
    lines = [r[0] for r in results.markdown(s.withColumn("run_id", F.lit("r"))).collect()]
    assert lines[0].startswith("| run |") and "0.7000" in lines[2]
