"""The front door: tables and metric names in, scores in long form out, in one plan.

``evaluate`` takes the tables that an evaluation has (``Inputs``), the names of registered metrics and cut-offs, and
returns query_id, metric, k (null for metrics of answers), score and error for every query of the query table:
metrics of one family share one computation, retrieval scores of queries without results are 0, and a metric that
lacks a table, or whose plan can't be made, has rows with an error instead of scores; the others still have theirs.
``run_suite`` does so for several named runs.  Metrics, like judges, retrievers and taggers, can be registered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, fields
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import judge, metrics, reasoning

LONG = "query_id, metric, k, score"


@dataclass
class Config:
    """What an evaluation is run with; unknown keys of a dictionary are ignored."""

    judge: str = "rules"
    judge_version: str = "1"
    max_retries: int = 4
    k_values: list[int] = field(default_factory=lambda: [5, 10, 20])
    metrics: list[str] = field(default_factory=list)
    threshold: float = 0.0
    preset: str = "balanced"
    seed: int = 42
    output_dir: str | None = None
    output_format: str = "json"

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})


@dataclass
class Inputs:
    """Tables of an evaluation; those that it doesn't have are None.

    queries: query_id, and for some metrics temporal_focus, baseline, comparison.  run: query_id, doc_id, rank, and for
    metrics by years qft, dft.  qrels: query_id, doc_id, gain.  answers: query_id, sample_id, years, and qft for recall.
    answer_texts: query_id, answer, and what a judge needs (qft, context, baseline, comparison), one row a query."""

    queries: DataFrame
    run: DataFrame | None = None
    qrels: DataFrame | None = None
    answers: DataFrame | None = None
    answer_texts: DataFrame | None = None


#: family(inputs, names, ks, config) -> query_id, metric, k, score
Family = Callable[[Inputs, list[str], tuple[int, ...], Config], DataFrame]


@dataclass(frozen=True)
class Metric:
    name: str
    layer: str  # retrieval, generation, reasoning or composite
    family: Family
    needs: tuple[str, ...] = ()  # table, or table.column
    requires_gold: bool = False
    requires_judge: bool = False
    higher_is_better: bool = True

    @property
    def by_k(self) -> bool:
        return self.layer == "retrieval"

    def lacks(self, inputs: Inputs) -> list[str]:
        out = []
        for need in self.needs:
            table, _, column = need.partition(".")
            df = getattr(inputs, table)
            if df is None or (column and column not in df.columns):
                out.append(need)
        return out


def _focus(inputs: Inputs, names: list[str], ks: tuple[int, ...], config: Config) -> DataFrame:
    own = [n.removeprefix("focus_") for n in names]
    return metrics.focus(inputs.run, ks, own, config.threshold).withColumn("metric", F.concat(F.lit("focus_"), "metric"))


def _gold(inputs: Inputs, names: list[str], ks: tuple[int, ...], config: Config) -> DataFrame:
    return metrics.gold(inputs.run, inputs.qrels, ks, [n.removeprefix("gold_") for n in names]).withColumn("metric", F.concat(F.lit("gold_"), "metric"))


def _judged(inputs: Inputs, names: list[str], ks: tuple[int, ...], config: Config) -> DataFrame:
    return metrics.judged(judged_run(inputs, config), ks).where(F.col("metric").isin(*names))


def judged_run(inputs: Inputs, config: Config) -> DataFrame:
    """The ranked documents with a judge's verdicts in the shape that metrics.judged takes."""
    about = [c for c in ("temporal_focus", "baseline", "comparison") if c in inputs.queries.columns and c not in inputs.run.columns]
    rows = inputs.run.join(inputs.queries.select("query_id", *about), "query_id") if about else inputs.run
    said = judge.verdicts(rows, ("precision", "recall", "ndcg", "coverage"), config.judge, version=config.judge_version)
    keep = ["query_id", "doc_id", "rank", *(c for c in ("temporal_focus",) if c in said.columns)]
    return said.select(*keep, "precision.verdict", "recall.is_relevant", "recall.relevance_score", F.col("ndcg.relevance_score").alias("graded"), "coverage.covers_baseline", "coverage.covers_comparison")


def _answer_judge(inputs: Inputs, names: list[str], ks: tuple[int, ...], config: Config) -> DataFrame:
    said = judge.verdicts(inputs.answer_texts, tuple(ANSWER_KINDS[n] for n in names), config.judge, ("query_id",), config.judge_version)
    cells = [F.struct(F.lit(n).alias("metric"), F.lit(None).cast("int").alias("k"), F.round(F.col(f"{kind}.{judge.CONTRACTS[kind].split()[0]}").cast("double"), 5).alias("score")) for n in names for kind in [ANSWER_KINDS[n]]]
    return said.select("query_id", F.inline(F.array(*cells)))


def _consistency(inputs: Inputs, names: list[str], ks: tuple[int, ...], config: Config) -> DataFrame:
    return reasoning.consistency(inputs.answers).select("query_id", F.lit(names[0]).alias("metric"), F.lit(None).cast("int").alias("k"), "score")


# The kind of verdict behind each metric of answers.
ANSWER_KINDS = {"temporal_faithfulness": "faithfulness", "temporal_hallucination": "hallucination", "temporal_coherence": "coherence", "answer_temporal_alignment": "alignment", "event_ordering": "ordering", "duration_accuracy": "duration", "cross_period_reasoning": "cross_period"}
_YEARS = ("run.rank", "run.qft", "run.dft")

METRICS: dict[str, Metric] = {}


def register_metric(metric: Metric) -> None:
    METRICS[metric.name.lower()] = metric


for _m in metrics.FOCUS:
    register_metric(Metric(f"focus_{_m}", "retrieval", _focus, _YEARS))
for _m in metrics.GOLD:
    register_metric(Metric(f"gold_{_m}", "retrieval", _gold, ("run.rank", "qrels.gain"), requires_gold=True))
for _m in ("judged_precision", "judged_recall", "judged_ndcg", "judged_mrr", "temporal_relevance", "temporal_coverage"):
    register_metric(Metric(_m, "retrieval", _judged, ("run.rank", "queries.baseline") if _m == "temporal_coverage" else ("run.rank",), requires_judge=True))
for _m, _kind in ANSWER_KINDS.items():
    register_metric(Metric(_m, "reasoning" if _kind in ("ordering", "duration", "cross_period") else "generation", _answer_judge, ("answer_texts.answer",), requires_judge=True, higher_is_better=_kind != "hallucination"))
register_metric(Metric("temporal_consistency", "reasoning", _consistency, ("answers.years",)))


def get_metric(name: str) -> Metric:
    if name.lower() not in METRICS:
        raise ValueError(f"no metric named {name}; known: {', '.join(list_metrics())}")
    return METRICS[name.lower()]


def list_metrics(layer: str | None = None, requires_gold: bool | None = None, requires_judge: bool | None = None, higher_is_better: bool | None = None) -> list[str]:
    """Names of registered metrics with the given flags."""
    asked = {"layer": layer, "requires_gold": requires_gold, "requires_judge": requires_judge, "higher_is_better": higher_is_better}
    return sorted(n for n, m in METRICS.items() if all(v is None or getattr(m, f) == v for f, v in asked.items()))


def evaluate(inputs: Inputs, names: Iterable[str], ks: Iterable[int] | None = None, config: Config | None = None) -> DataFrame:
    """query_id, metric, k, score, error of every query and named metric."""
    config = config or Config()
    ks = tuple(ks or config.k_values)
    chosen = [get_metric(n) for n in dict.fromkeys(names)]
    if not chosen:
        raise ValueError("no metrics named")
    errors: dict[str, str] = {m.name: f"lacks {', '.join(m.lacks(inputs))}" for m in chosen if m.lacks(inputs)}
    families: dict[Family, list[str]] = {}
    for m in chosen:
        if m.name not in errors:
            families.setdefault(m.family, []).append(m.name)
    made = []
    for family, members in families.items():
        try:
            made.append(family(inputs, members, ks, config).select("query_id", "metric", F.col("k").cast("int").alias("k"), F.col("score").cast("double").alias("score")))
        except Exception as e:  # a plan that can't be made
            errors |= {n: f"{type(e).__name__}: {str(e).splitlines()[0]}"[:500] for n in members}
    nothing = lambda m: F.lit(0.0) if m.by_k and m.name not in errors else F.lit(None).cast("double")
    cells = [F.struct(F.lit(m.name).alias("metric"), F.lit(k).cast("int").alias("k"), nothing(m).alias("none"), F.lit(errors.get(m.name)).cast("string").alias("error")) for m in chosen for k in (ks if m.by_k else (None,))]
    grid = inputs.queries.select("query_id").distinct().select("query_id", F.inline(F.array(*cells)))
    if not made:
        return grid.select("query_id", "metric", "k", F.col("none").alias("score"), "error")
    got = reduce(DataFrame.unionByName, made).withColumn("k", F.coalesce("k", F.lit(0)))
    out = grid.withColumn("k0", F.coalesce("k", F.lit(0))).join(got.withColumnsRenamed({"k": "k0", "score": "found"}), ["query_id", "metric", "k0"], "left")
    return out.select("query_id", "metric", "k", F.coalesce("found", "none").alias("score"), "error")


def run_suite(runs: dict[str, Inputs], names: Iterable[str], ks: Iterable[int] | None = None, config: Config | None = None) -> DataFrame:
    """evaluate for each named run: run_id before its columns."""
    names = list(names)
    return reduce(DataFrame.unionByName, [evaluate(i, names, ks, config).select(F.lit(r).alias("run_id"), "*") for r, i in runs.items()])


def component(scores: DataFrame, name: str) -> Column:
    """Inside an aggregation by query: the score of a metric by its name without k, else at its lowest k, else 0."""
    mine = F.col("metric") == name
    plain = F.max(F.when(mine & F.col("k").isNull(), F.col("score")))
    lowest = F.min(F.when(mine & F.col("k").isNotNull(), F.struct("k", "score")))["score"]
    return F.coalesce(plain, lowest, F.lit(0.0))


def composite(scores: DataFrame, precision: str, recall: str, faithfulness: str, coherence: str, preset: str = "balanced") -> DataFrame:
    """query_id and the composite scores of four metrics in long form, looked up by name."""
    weights, retrieval = reasoning.PRESETS[preset]
    parts = scores.groupBy("query_id").agg(*(component(scores, n).alias(f"part{i}") for i, n in enumerate((precision, recall, faithfulness, coherence))))
    return parts.select("query_id", *(c.alias(n) for n, c in reasoning.composite(*(F.col(f"part{i}") for i in range(4)), weights, retrieval).items()))
