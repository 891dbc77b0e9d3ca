"""Years that a text is about, as a sorted array of distinct integers.

All functions take and give columns and stay inside the JVM.  A null text has no years.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of years of each kind of extraction.
YEARS_1800 = r"\b(1[89][0-9]{2}|20[0-9]{2})\b"
YEARS_1900 = r"\b(19[0-9]{2}|20[0-9]{2})\b"
YEARS_OR_DECADES = r"(?i)\b((?:1[89][0-9]{2}|20[0-9]{2})s?)\b"
DECADE_OF_YEAR = r"\b((?:19|20)[0-9])[0-9]\b"

# Phrases of queries and the years they stand for, first and last.
PHRASES = {
    "wwi": (1914, 1918),
    "world war i": (1914, 1918),
    "world war 1": (1914, 1918),
    "wwii": (1939, 1945),
    "world war ii": (1939, 1945),
    "world war 2": (1939, 1945),
    "cold war": (1947, 1991),
    "great depression": (1929, 1939),
    "victorian era": (1837, 1901),
    "covid": (2020, 2023),
    "pandemic": (2020, 2022),
}

# Relative phrases with the first and last year they stand for, counted from the current one.
RELATIVE = {
    "recently": (-2, 0),
    "currently": (0, 0),
    "today": (0, 0),
    "last year": (-1, -1),
    "this year": (0, 0),
    "last decade": (-10, -1),
}
PAST_YEARS = r"past\s+[0-9]+\s+years?"
LONGEST_PAST = 10_000  # years; keeps "past N years" from making arrays of any size


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def none() -> Column:
    return F.array().cast("array<int>")


def year_set(x: Column) -> Column:
    """Sorted, distinct, never null."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(x, lambda y: y.isNotNull()))), none())


def year_range(first: Column | int, last: Column | int) -> Column:
    """All years from first to last; none if last is before first."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.when(a <= b, F.sequence(a, b)).otherwise(none())


def _found(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))


def explicit_years(text: Column | str) -> Column:
    """Years 1800-2099, and the ten years of each decade that is written out ("1990s"); one pass over the text."""
    found = F.array_distinct(F.regexp_extract_all(_c(text), F.lit(YEARS_OR_DECADES), F.lit(1)))
    first = lambda x: F.substring(x, 1, 4).cast("int")
    decade = lambda x: F.when(F.substring(x, 4, 1) == "0", F.sequence(first(x), first(x) + 9)).otherwise(none())
    return year_set(F.flatten(F.transform(found, lambda x: F.when(F.length(x) == 4, F.array(first(x))).otherwise(decade(x)))))


def years_1900(text: Column | str) -> Column:
    """Years 1900-2099 as written, distinct and sorted."""
    return year_set(_found(_c(text), YEARS_1900))


def phrase_years(text: Column | str) -> Column:
    """Years of the PHRASES in a text; a phrase inside a longer one that is there too doesn't count.  One pass over the
    text, for the longest phrase at each place."""
    either = "|".join(sorted(PHRASES, key=lambda p: (-len(p), p)))
    found = F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit(rf"\b({either})\b"), F.lit(1)))
    whole = F.filter(found, lambda p: ~F.exists(found, lambda q: (q != p) & F.contains(q, p)))
    spans = F.create_map(*(x for p, (a, b) in PHRASES.items() for x in (F.lit(p), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))))
    return year_set(F.flatten(F.transform(whole, lambda p: F.sequence(spans[p]["a"], spans[p]["b"]))))


def relative_years(text: Column | str, current_year: Column | int) -> Column:
    """Years of relative phrases, counted from a given current year; one pass over the text."""
    now = F.lit(current_year) if isinstance(current_year, int) else current_year
    either = "|".join([*(p.replace(" ", r"\s+") for p in RELATIVE), PAST_YEARS])
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(_c(text)), F.lit(rf"\b({either})\b"), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", " ")))

    def years(x: Column) -> Column:
        digits = F.regexp_extract(x, r"[0-9]+", 0)
        n = F.when(F.length(digits) < 6, F.least(F.substring(digits, 1, 5).try_cast("int"), F.lit(LONGEST_PAST))).otherwise(F.lit(LONGEST_PAST))
        out = F.when(digits != "", year_range(now - n, now))
        for p, (a, b) in RELATIVE.items():
            out = out.when(x == p, year_range(now + a, now + b))
        return out.otherwise(none())

    return year_set(F.flatten(F.transform(found, years)))


def query_years(text: Column | str, current_year: Column | int) -> Column:
    """What a query is about: explicit years, phrases and relative phrases."""
    return year_set(F.concat(explicit_years(text), phrase_years(text), relative_years(text, current_year)))


def document_years(text: Column | str) -> Column:
    """What a document or an answer is about: explicit years only."""
    return explicit_years(text)


def decades_1900(text: Column | str) -> Column:
    """Distinct decades (as 199 for the 1990s) of the years 1900-2099 in a text."""
    return year_set(_found(_c(text), DECADE_OF_YEAR))


def anchors(text: Column | str) -> Column:
    """Time anchors in a text: years 1900-2099 and decades ("1990s", "90s"), in lower case."""
    t = F.coalesce(_c(text), F.lit(""))
    years = F.regexp_extract_all(t, F.lit(YEARS_1900), F.lit(1))
    decades = F.regexp_extract_all(F.lower(t), F.lit(r"\b((?:the\s+)?(?:19|20)?[0-9]0s)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(years, decades)))


# Fuzzy years: maps from year to weight, for vague phrases.


def _weights(first: Column, step: int, n: Column | int, decay: float) -> Column:
    i = F.when(F.lit(n) > 0, F.sequence(F.lit(0), F.lit(n) - 1)).otherwise(none()) if isinstance(n, int) else F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none())
    return F.map_from_arrays(F.transform(i, lambda x: first + x * step), F.transform(i, lambda x: F.greatest(F.lit(0.0), 1.0 - x * F.lit(decay))))


def fuzzy_recently(base: Column, decay: float = 0.1) -> Column:
    """The last ten years, less each year back."""
    return _weights(base, -1, 10, decay)


def fuzzy_before(year: Column, decay: float = 0.1) -> Column:
    """Twenty years before a year."""
    return _weights(year - 1, -1, 20, decay)


def fuzzy_after(year: Column, base: Column, decay: float = 0.1) -> Column:
    """From the year after up to a base year."""
    return _weights(year + 1, 1, base - year, decay)


def fuzzy_around(year: Column, spread: int = 2, decay: float = 0.3) -> Column:
    """A year and its neighbours on both sides."""
    keys = F.array(*(year + d for d in range(-spread, spread + 1)))
    return F.map_from_arrays(keys, F.array(*(F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(abs(d)) * F.lit(decay)) for d in range(-spread, spread + 1))))


def fuzzy_support(weights: Column) -> Column:
    """Years with a weight over 0."""
    return F.array_sort(F.map_keys(F.map_filter(weights, lambda y, w: w > 0)))


def weighted_overlap(weights: Column, years: Column) -> Column:
    """Sum of the weights of years."""
    return F.aggregate(F.array_distinct(years), F.lit(0.0), lambda s, y: s + F.coalesce(F.try_element_at(weights, y), F.lit(0.0)))
