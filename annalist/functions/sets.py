"""Operations on arrays of years.  A null set is an empty one; ratios with nothing below are 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .years import none, year_set


def _s(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, none())


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def intersection(a, b) -> Column:
    return year_set(F.array_intersect(_s(a), _s(b)))


def union(a, b) -> Column:
    return year_set(F.array_union(_s(a), _s(b)))


def size(a) -> Column:
    return F.size(_s(a))


def overlap(a, b) -> Column:
    """How many years are in both."""
    return F.size(F.array_intersect(_s(a), _s(b)))


def jaccard(a, b) -> Column:
    return ratio(overlap(a, b), F.size(F.array_union(_s(a), _s(b))))


def contained(a, b) -> Column:
    """Whether b holds all of a."""
    return F.size(F.array_except(_s(a), _s(b))) == 0


def covers(a, b, threshold: float = 0.0) -> Column:
    """Any overlap at threshold 0, else a Jaccard similarity of at least the threshold."""
    return overlap(a, b) > 0 if threshold == 0 else jaccard(a, b) >= threshold


def relevance(query, doc, mode: str = "any") -> tuple[Column, Column]:
    """(relevant, score) by any overlap, by Jaccard similarity or by holding all of the query's years.
    Nothing is relevant to an empty set; unknown modes count as any."""
    both = (size(query) > 0) & (size(doc) > 0)
    if mode == "jaccard":
        yes, score = jaccard(query, doc) > 0, jaccard(query, doc)
    elif mode == "all":
        yes = contained(query, doc)
        score = yes.cast("double")
    else:
        yes = overlap(query, doc) > 0
        score = yes.cast("double")
    return F.coalesce(both & yes, F.lit(False)), F.when(both, score).otherwise(0.0)
