import pytest
from pyspark.sql import functions as F

from annalist.functions import sets, spans, text, years


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<int>").alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("s", "expected"),
    [
        ("From 1990 to 1995, it grew", [1990, 1995]),
        ("During the 1990s, technology", list(range(1990, 2000))),
        ("1799 1800 2099 2100", [1800, 2099]),
        ("x1999 1999_ 20150 é1999", []),
        ("", []),
    ],
)
def test_explicit_years(spark, s, expected):
    assert one(spark, years.explicit_years("t"), t=s) == expected


def test_null_text_has_no_years(spark):
    d = spark.sql("SELECT CAST(NULL AS STRING) AS t")
    assert d.select(years.query_years("t", 2026)).first()[0] == []


@pytest.mark.parametrize(
    ("s", "expected"),
    [
        ("World War II battles", list(range(1939, 1946))),
        ("World War I and world war ii", list(range(1939, 1946))),
        ("wwi and wwii", list(range(1939, 1946))),
        ("the Great Depression", list(range(1929, 1940))),
        ("covid", [2020, 2021, 2022, 2023]),
        ("covidence", []),
    ],
)
def test_phrases(spark, s, expected):
    assert one(spark, years.phrase_years("t"), t=s) == expected


@pytest.mark.parametrize(("s", "expected"), [("Recently", [2024, 2025, 2026]), ("last year", [2025]), ("last  decade", list(range(2016, 2026))), ("past 3 years", [2023, 2024, 2025, 2026]), ("today", [2026]), ("no time", [])])
def test_relative(spark, s, expected):
    assert one(spark, years.relative_years("t", 2026), t=s) == expected


def test_past_years_are_bounded(spark):
    assert len(one(spark, years.relative_years("t", 2026), t="past 99999999999 years")) == years.LONGEST_PAST + 1


def test_fuzzy(spark):
    w = one(spark, years.fuzzy_around(F.lit(2000)))
    assert {k: round(v, 6) for k, v in w.items()} == {1998: 0.4, 1999: 0.7, 2000: 1.0, 2001: 0.7, 2002: 0.4}
    w = one(spark, years.fuzzy_recently(F.lit(2026)))
    assert len(w) == 10 and w[2026] == 1.0 and round(w[2017], 6) == 0.1
    assert len(one(spark, years.fuzzy_support(years.fuzzy_before(F.lit(2000))))) in (10, 11)
    assert one(spark, years.fuzzy_after(F.lit(2026), F.lit(2020))) == {}
    assert round(one(spark, years.weighted_overlap(years.fuzzy_around(F.lit(2000)), F.array(F.lit(1999), F.lit(1980)))), 6) == 0.7


def test_sets(spark):
    a, b = [2019, 2020, 2021], [2020, 2021, 2022]
    assert one(spark, sets.intersection("a", "b"), a=a, b=b) == [2020, 2021]
    assert one(spark, sets.union("a", "b"), a=a, b=b) == [2019, 2020, 2021, 2022]
    assert one(spark, sets.overlap("a", "b"), a=a, b=b) == 2
    assert one(spark, sets.jaccard("a", "b"), a=a, b=b) == 0.5
    assert one(spark, sets.jaccard("a", "b"), a=[], b=[]) == 0.0
    assert one(spark, years.year_range(5, 2)) == []
    yes, score = sets.relevance("a", "b", "jaccard")
    assert one(spark, yes, a=[2020, 2021], b=[2020, 2022]) and one(spark, score, a=[2020, 2021], b=[2020, 2022]) == pytest.approx(1 / 3)
    yes, score = sets.relevance("a", "b", "all")
    assert not one(spark, yes, a=[], b=[2020]) and one(spark, score, a=[], b=[2020]) == 0.0


def test_durations(spark):
    assert sorted(one(spark, text.durations("t"), t="4 years and 3 months, about 2.5 decades, 1 century")) == [90.0, 1460.0, 9125.0, 36500.0]
    gold = F.array(text.duration_days(F.lit("4 years")))
    assert [one(spark, text.duration_accuracy("t", gold), t=s) for s in ("4 years", "5 years", "4 years then 4 years", "")] == [1.0, 0.0, 2.0, 0.0]
    two = F.array(text.duration_days(F.lit("4 years")), text.duration_days(F.lit("3 months")))
    assert one(spark, text.duration_accuracy("t", two), t="4 years") == 0.5
    assert one(spark, text.duration_days(F.lit("two centuries"))) is None


def test_json(spark):
    for s, expected in (('```json\n{"k": 3}\n```', 3), ('Well: {"k": 4} so', 4), ("nothing", None), ('{"k": ', None)):
        got = one(spark, text.json_answer("t", "k int"), t=s)
        assert (got["k"] if got else None) == expected


def test_labels(spark):
    assert [one(spark, text.question_focus("t"), t=s) for s in ("When did it end", "How long was it", "Who came before", "How has it changed", "Why")] == ["specific_time", "duration", "temporal_ordering", "change_over_time", "specific_time"]
    assert one(spark, text.is_cross_period(F.lit("x"), "t"), t="the evolution of law")


def test_cost(spark):
    assert one(spark, text.cost(F.lit("m"), F.lit(1000), F.lit(1000))) == pytest.approx(0.0125)
    assert one(spark, text.safe(F.lit(float("nan")), 7.0)) == 7.0


def test_spans(spark):
    d = spark.createDataFrame([(1, "In 1999 we ran 5 years, recently from 1990 to 1995"), (2, None)], "id int, t string")
    got = [(r["kind"], r["text"], r["start_pos"]) for r in spans.spans(d, "id", "t").collect()]
    assert ("year", "1999", 3) in got and ("duration", "5 years", 15) in got and ("relative", "recently", 24) in got and ("range", "from 1990 to 1995", 33) in got
    assert [r[0] for r in d.select(spans.has_temporal_content("t")).collect()] == [True, False]
