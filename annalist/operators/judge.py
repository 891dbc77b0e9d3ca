"""Judges: verdicts on (query, document) and (query, answer) rows, as JSON, kept in a table.

A judge is any object with ``answer(kind, row) -> str`` (JSON in the shape of CONTRACTS[kind]); it runs in
``mapInArrow`` batches.  One that can't take long texts has ``limits``: the characters it gets of a column, by
the column's name (prompts usually take 2,000 of doc, 8,000 of context and all of answer).  Verdicts are keyed by (query_id, doc_id, judge, kind, version): ``resume`` asks only for
those that a table doesn't hold yet (an anti-join), since tasks may run twice and calls may cost money.
``RuleJudge`` answers by sets of years, deterministically; a judge with ``columns(kind, rows)`` is asked in column expressions.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sets
from ..functions.text import json_answer
from ..functions.years import YEARS_1800, none, year_set
from ..shipping import ship

#: The fields of each kind of verdict.
CONTRACTS = {
    "precision": "verdict int",
    "recall": "is_relevant boolean, relevance_score double",
    "mrr": "is_relevant boolean",
    "ndcg": "relevance_score double",
    "coverage": "covers_baseline boolean, covers_comparison boolean",
    "anchors": "extracted_anchors array<string>",
    "periods": "unique_years array<int>",
    "years": "all_years array<int>",
    "faithfulness": "faithfulness_score double",
    "hallucination": "hallucination_rate double",
    "coherence": "coherence_score double",
    "alignment": "alignment_score double",
    "ordering": "ordering_score double",
    "duration": "accuracy_score double",
    "cross_period": "cross_period_score double",
}
#: Statuses of answers that are worth another try.
RETRY_STATUS = frozenset((408, 409, 429, 500, 502, 503, 504))


class Judge(Protocol):
    name: str

    def answer(self, kind: str, row: dict[str, Any]) -> str: ...


def should_retry(error: Exception) -> bool:
    status = getattr(error, "status_code", None) or getattr(error, "status", None)
    return status in RETRY_STATUS or bool(re.search(r"time.?out|rate limit|overloaded|temporar|connection|unavailable", str(error), re.I))


def with_retries(call: Callable[[], str], tries: int = 4, sleep: Callable[[float], None] = time.sleep) -> str:
    for n in range(tries):
        try:
            return call()
        except Exception as e:
            if n == tries - 1 or not should_retry(e):
                raise
            sleep(min(10.0, 0.8 * 2**n) * random.uniform(0.7, 1.3))
    raise AssertionError


_YEAR = re.compile(r"\b(1[89][0-9]{2}|20[0-9]{2})\b")


def _years(x) -> set[int]:
    return {int(y) for y in _YEAR.findall(x or "")} if isinstance(x, str) or x is None else set(x)


class RuleJudge:
    """By the years in query, document, answer and context: rows hold any of qft, dft (or query, doc), answer,
    context, baseline, comparison.  ``columns`` gives the same verdicts inside the JVM."""

    name = "rules"

    def columns(self, kind: str, rows: DataFrame) -> Column:
        """The verdict as a struct of the contract's fields."""
        types = dict(rows.dtypes)

        def found(*names: str) -> Column:
            out = [F.col(n) if types[n].startswith("array") else F.transform(F.regexp_extract_all(F.col(n).cast("string"), F.lit(YEARS_1800), F.lit(1)), lambda x: x.cast("int")) for n in names if n in types]
            return F.coalesce(*out, none()) if out else none()

        def holds(years: Column, name: str) -> Column:
            return F.coalesce(F.array_contains(years, F.col(name).cast("int")), F.lit(False)) if name in types else F.lit(False)

        q, d, a, c = (year_set(found(*names)) for names in (("qft", "query"), ("dft", "doc"), ("answer",), ("context",)))
        any_, share = sets.overlap(q, d) > 0, sets.jaccard(q, d)
        known = F.when(F.size(a) > 0, sets.ratio(sets.overlap(a, c), F.size(a))).otherwise(1.0)
        met = sets.ratio(sets.overlap(a, q), F.size(q))
        written = F.array_distinct(found("answer"))
        scores = {
            "faithfulness": known,
            "hallucination": 1 - known,
            "coherence": F.when(F.size(a) < 3, 1.0).otherwise(2.0 / F.greatest(F.size(a), F.lit(1))),
            "alignment": met,
            "ordering": (written == a).cast("double"),
            "duration": met,
            "cross_period": (holds(a, "baseline").cast("int") + holds(a, "comparison").cast("int")) / 2.0,
        }
        fields = {
            "precision": lambda: [any_.cast("int")],
            "recall": lambda: [any_, F.round(share, 6)],
            "mrr": lambda: [any_],
            "ndcg": lambda: [F.round(4 * share, 6)],
            "coverage": lambda: [holds(d, "baseline"), holds(d, "comparison")],
            "anchors": lambda: [F.transform(d, lambda y: y.cast("string"))],
            "periods": lambda: [year_set(F.transform(d, lambda y: (F.floor(y / 5) * 5).cast("int")))],
            "years": lambda: [d],
        }
        values = fields[kind]() if kind in fields else [F.round(scores[kind], 6)]
        return F.struct(*(v.alias(f.split()[0]) for v, f in zip(values, CONTRACTS[kind].split(", "), strict=True)))

    def answer(self, kind: str, row: dict[str, Any]) -> str:
        q = _years(row.get("qft") if row.get("qft") is not None else row.get("query"))
        d = _years(row.get("dft") if row.get("dft") is not None else row.get("doc"))
        both, either = len(q & d), len(q | d)
        share = both / either if either else 0.0
        if kind in ("precision",):
            out = {"verdict": int(both > 0)}
        elif kind in ("recall", "mrr"):
            out = {"is_relevant": both > 0, "relevance_score": round(share, 6)}
        elif kind == "ndcg":
            out = {"relevance_score": round(4 * share, 6)}
        elif kind == "coverage":
            out = {"covers_baseline": row.get("baseline") in d, "covers_comparison": row.get("comparison") in d}
        elif kind == "anchors":
            out = {"extracted_anchors": [str(y) for y in sorted(d)]}
        elif kind == "periods":
            out = {"unique_years": sorted({y // 5 * 5 for y in d})}
        elif kind == "years":
            out = {"all_years": sorted(d)}
        else:
            a, c = _years(row.get("answer")), _years(row.get("context"))
            known = len(a & c) / len(a) if a else 1.0
            met = len(a & q) / len(q) if q else 0.0
            score = {"faithfulness": known, "hallucination": 1 - known, "coherence": 1.0 if len(a) < 3 else round(2 / len(a), 6), "alignment": met, "ordering": float(sorted(a) == [int(y) for y in dict.fromkeys(_YEAR.findall(row.get("answer") or ""))]), "duration": met, "cross_period": ((row.get("baseline") in a) + (row.get("comparison") in a)) / 2}
            field = CONTRACTS[kind].split()[0]
            out = {field: round(score[kind], 6)}
        return json.dumps(out)


#: name -> factory; others register their own.
JUDGES: dict[str, Callable[..., Judge]] = {"rules": RuleJudge}


def register_judge(name: str, factory: Callable[..., Judge]) -> None:
    JUDGES[name.lower()] = factory


def get_judge(name: str | Judge, **options) -> Judge:
    if not isinstance(name, str):
        return name
    if name.lower() not in JUDGES:
        raise ValueError(f"no judge named {name}; known: {', '.join(sorted(JUDGES))}")
    return JUDGES[name.lower()](**options)


def _limited(rows: DataFrame, who: Judge, keys: tuple[str, ...]) -> DataFrame:
    limits = getattr(who, "limits", {})
    return rows.select(*(F.substring(c, 1, limits[c]).alias(c) if t == "string" and c in limits and c not in keys else F.col(c) for c, t in rows.dtypes))


def judge(rows: DataFrame, kind: str, by: str | Judge = "rules", keys: tuple[str, ...] = ("query_id", "doc_id"), version: str = "1") -> DataFrame:
    """keys, judge, kind, version, payload (JSON, null after an error), error.  Judges get whole texts, but for the
    columns in their ``limits``, which are cut before they leave the JVM."""
    who = get_judge(by)
    cut = _limited(rows, who, keys)
    if hasattr(who, "columns"):
        said = [F.lit(who.name).alias("judge"), F.lit(kind).alias("kind"), F.lit(version).alias("version")]
        return cut.select(*keys, *said, F.to_json(who.columns(kind, cut)).alias("payload"), F.lit(None).cast("string").alias("error"))
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payload, error = [], []
            for row in b.to_pylist():
                try:
                    payload.append(with_retries(lambda row=row: who.answer(kind, row)))
                    error.append(None)
                except Exception as e:
                    payload.append(None)
                    error.append(f"{type(e).__name__}: {e}"[:500])
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array([x] * n, pa.string()) for x in (who.name, kind, version)), pa.array(payload, pa.string()), pa.array(error, pa.string())], names=[*keys, "judge", "kind", "version", "payload", "error"])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return cut.mapInArrow(run, f"{schema}, judge string, kind string, version string, payload string, error string")


def resume(rows: DataFrame, kept: DataFrame, kind: str, by: str | Judge = "rules", keys: tuple[str, ...] = ("query_id", "doc_id"), version: str = "1") -> DataFrame:
    """Verdicts for the rows that ``kept`` has none for."""
    done = kept.where((F.col("kind") == kind) & (F.col("judge") == get_judge(by).name) & (F.col("version") == version) & F.col("payload").isNotNull()).select(*keys).distinct()
    return judge(rows.join(done, list(keys), "left_anti"), kind, by, keys, version)


def verdicts(rows: DataFrame, kinds: tuple[str, ...], by: str | Judge = "rules", keys: tuple[str, ...] = ("query_id", "doc_id"), version: str = "1") -> DataFrame:
    """rows with a struct of the contract's fields for each kind, in one pass where the judge works on columns, else
    joined by keys."""
    who = get_judge(by)
    if hasattr(who, "columns") and not getattr(who, "limits", None):
        return rows.select("*", *(who.columns(kind, rows).alias(kind) for kind in kinds))
    for kind in kinds:
        got = judge(rows, kind, who, keys, version).select(*keys, json_answer("payload", CONTRACTS[kind]).alias(kind))
        rows = rows.join(got, list(keys), "left")
    return rows


def parsed(judgments: DataFrame, kind: str) -> DataFrame:
    """Judgments of a kind with the fields of its contract; null where there is none."""
    return judgments.where(F.col("kind") == kind).withColumn("_p", json_answer("payload", CONTRACTS[kind])).select("*", "_p.*").drop("_p")


def score(judgments: DataFrame, kind: str, digits: int = 5) -> DataFrame:
    """query_id, score of an answer's judgment: 0 after an error, but null for alignment."""
    field = CONTRACTS[kind].split()[0]
    value = F.round(F.col(field).cast("double"), digits)
    return parsed(judgments, kind).select("query_id", (value if kind == "alignment" else F.coalesce(value, F.lit(0.0))).alias("score"))
