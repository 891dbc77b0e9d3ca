"""Reasoning and composite metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sets


def ordering_agreement(predicted: Column, expected: Column) -> Column:
    """1 - inversions / pairs of two arrays of events, where pairs are those of the predicted list, known to
    the expected one or not.  Empty lists agree not at all, one event fully; of a repeated expected event the
    last place counts."""
    n = F.size(predicted)
    last = F.transform(predicted, lambda e: F.size(expected) - F.array_position(F.reverse(expected), e) + F.when(F.array_contains(expected, e), 1).otherwise(F.lit(None)))
    known = F.filter(last, lambda p: p.isNotNull())
    inversions = F.aggregate(F.transform(known, lambda x, i: F.size(F.filter(known, lambda y, j: (j > i) & (x > y)))), F.lit(0), lambda s, x: s + x)
    return F.when((n <= 0) | (F.size(expected) <= 0), 0.0).when(n == 1, 1.0).otherwise(1.0 - inversions / F.greatest(n * (n - 1) / 2.0, F.lit(1.0)))


def consistency(answers: DataFrame) -> DataFrame:
    """Share of pairs of answers (query_id, sample_id, years) with the same years, of answers with any.

    Equal sets are counted, not paired: with n answers of which groups have m equal ones it is the sum of
    m (m - 1) over n (n - 1)."""
    sets_ = answers.where(F.size("years") > 0).groupBy("query_id", "years").agg(F.count("*").alias("m"))
    per = sets_.groupBy("query_id").agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1)).alias("same"))
    every = answers.select("query_id").distinct()
    return every.join(per, "query_id", "left").select("query_id", F.round(F.coalesce(sets.ratio(F.col("same").cast("double"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)), 5).alias("score"))


def answer_year_recall(answer, query) -> Column:
    return F.round(sets.ratio(sets.overlap(answer, query).cast("double"), sets.size(query)), 5)


#: Weights of precision, recall, faithfulness and coherence, and of retrieval against generation.
PRESETS = {"retrieval": ((0.35, 0.35, 0.20, 0.10), 0.7), "generation": ((0.15, 0.15, 0.40, 0.30), 0.3), "balanced": ((0.25, 0.25, 0.25, 0.25), 0.5)}


def _f1(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / F.when(a + b > 0, a + b)).otherwise(0.0)


def composite(precision: Column, recall: Column, faithfulness: Column, coherence: Column, weights=(0.25, 0.25, 0.25, 0.25), retrieval_weight: float = 0.5, digits: int | None = 4) -> dict[str, Column]:
    """One score of four: weighted mean, harmonic mean (of those over 0) and layered F, with its two layers.
    Missing components are 0, negative ones too."""
    xs = [F.greatest(F.lit(0.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))) for x in (precision, recall, faithfulness, coherence)]
    total = sum(weights)
    weighted = sum((F.lit(w) * x for w, x in zip(weights, xs, strict=True)), F.lit(0.0)) / total
    above = sum((F.when(x > 0, F.lit(w)).otherwise(0.0) for w, x in zip(weights, xs, strict=True)), F.lit(0.0))
    below = sum((F.when(x > 0, F.lit(w) / F.when(x > 0, x)).otherwise(0.0) for w, x in zip(weights, xs, strict=True)), F.lit(0.0))
    harmonic = F.when(below > 0, above / F.when(below > 0, below)).otherwise(0.0)
    r, g = _f1(xs[0], xs[1]), _f1(xs[2], xs[3])
    beta2 = retrieval_weight**2
    layered = _f1(r, g) if retrieval_weight == 0.5 else (1 + beta2) * r * g / (beta2 * r + g + 1e-10)
    return {k: x if digits is None else F.round(x, digits) for k, x in {"weighted": weighted, "harmonic": harmonic, "f_score": layered, "retrieval_f1": r, "generation_f1": g}.items()}


def harmonic_mean(scores: Column, weights: Column | None = None) -> Column:
    """Weighted harmonic mean of an array of scores; null, NaN and not positive ones are left out; null if
    none is left."""
    pairs = F.arrays_zip(scores.alias("s"), weights.alias("w")) if weights is not None else F.transform(scores, lambda x: F.struct(x.alias("s"), F.lit(1.0).alias("w")))
    ok = F.filter(pairs, lambda p: p["s"].isNotNull() & ~F.isnan(p["s"]) & (p["s"] > 0))
    add = lambda f: F.aggregate(ok, F.lit(0.0), lambda a, p: a + f(p))
    return F.when(F.size(ok) > 0, F.round(add(lambda p: p["w"]) / add(lambda p: p["w"] / p["s"]), 5))
