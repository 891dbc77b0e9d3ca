"""Meta-evaluation: perturb inputs and check that a metric moves as it should.  Seeds make all of it repeatable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.years import YEARS_1900

STATEMENTS = ("This happened in 1492.", "It ended two centuries later.", "All of it took place in 2087.")


def _pick(text: Column, seed: int, n: int) -> Column:
    """A number below n that depends on text and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), text)), 1, 8), 16, 10).cast("long") % n


def scramble_years(text: Column, seed: int = 0) -> Column:
    """Every year 1900-2099 moved by the same 3 to 22 years, which depend on text and seed."""
    shift = _pick(text, seed, 20) + 3
    parts = F.split(F.regexp_replace(text, YEARS_1900, "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(rf"^{YEARS_1900}$") , (F.when(p.rlike("^[0-9]{4}$"), p).otherwise("0").cast("int") + shift).cast("string")).otherwise(p)), "")


def shuffle_events(text: Column, seed: int = 0) -> Column:
    """Sentences in the order of their hash."""
    s = F.transform(F.split(text, r"\. "), lambda x: F.struct(F.md5(F.concat(F.lit(f"{seed}/"), x)).alias("h"), x.alias("s")))
    return F.array_join(F.transform(F.array_sort(s), lambda x: x["s"]), ". ")


def inject_hallucination(text: Column, seed: int = 0) -> Column:
    """One of three false statements at the end."""
    pick = (_pick(text, seed, len(STATEMENTS)) + 1).cast("int")
    return F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, STATEMENTS)), pick))


def validate(original: DataFrame, perturbed: DataFrame, expected: str = "expected") -> DataFrame:
    """case_id, passed: whether the perturbed score is lower, higher or the same, as expected.  Missing and
    null scores (errors) fail."""
    o, p = original.select("case_id", expected, F.col("score").alias("_o")), perturbed.select("case_id", F.col("score").alias("_p"))
    e, d = F.col(expected), F.col("_p") - F.col("_o")
    ok = F.when(e == "lower", d < 0).when(e == "higher", d > 0).when(e == "same", F.abs(d) < 1e-6).otherwise(F.lit(False))
    return o.join(p, "case_id", "left").select("case_id", e.alias("expected"), F.col("_o").alias("original"), F.col("_p").alias("perturbed"), F.coalesce(ok, F.lit(False)).alias("passed"))


def report(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count("*").alias("n"), F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


#: name -> perturbation of a text column.
PERTURBATIONS: dict[str, Callable[..., Column]] = {"scramble_years": scramble_years, "shuffle_events": shuffle_events, "inject_hallucination": inject_hallucination}


def register_perturbation(name: str, perturbation: Callable[..., Column]) -> None:
    PERTURBATIONS[name.lower()] = perturbation
