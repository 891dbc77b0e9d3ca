"""Durations, label inference, JSON answers of judges, and text helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .years import _c

# Words for a unit of time, and its days, in the order in which they are tried.
UNITS = {"year": (r"years|year", 365.0), "month": (r"months|month", 30.0), "week": (r"weeks|week", 7.0), "day": (r"days|day", 1.0), "decade": (r"decades|decade", 3650.0), "century": (r"centuries|century", 36500.0)}
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def durations(text: Column | str) -> Column:
    """Days of all durations in a text, unit by unit."""
    t = F.coalesce(_c(text), F.lit(""))

    def of(words: str, days: float) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(rf"(?i){NUMBER}\s*(?:{words})"), F.lit(1)), lambda x: x.cast("double") * days)

    return F.concat(*(of(*unit) for unit in UNITS.values()))


def duration_days(text: Column | str) -> Column:
    """Days of the first unit (in the order of UNITS) that a text gives a number for, else null."""
    t = F.lower(_c(text))
    return F.coalesce(*(F.when(t.rlike(rf"{NUMBER}\s*{unit}"), F.regexp_extract(t, rf"{NUMBER}\s*{unit}", 1).try_cast("double") * days) for unit, (_, days) in UNITS.items()))


def duration_accuracy(answer: Column | str, gold: Column, tolerance: float = 0.1) -> Column:
    """Durations of an answer that are near some gold duration (days), a gold one.  Repeats count."""
    near = F.filter(durations(answer), lambda d: (d != 0) & F.exists(gold, lambda g: g.isNotNull() & (g != 0) & (F.abs(d - g) / F.greatest(g, F.lit(1.0)) < tolerance)))
    return F.when(F.coalesce(F.size(gold), F.lit(0)) > 0, F.round(F.size(near) / F.size(gold), 4)).otherwise(0.0)


# Label inference.  Fixed values: the words looked for, in order.
_TIME = "when did|when was|what year|what date"


def question_focus(question: Column | str) -> Column:
    q = F.lower(_c(question))
    return F.when(q.rlike(_TIME), "specific_time").when(q.rlike("how long|duration|lasted"), "duration").when(q.rlike("before|after|first|last|prior"), "temporal_ordering").when(q.rlike("changed|since|trend|over time"), "change_over_time").otherwise("specific_time")


def typed_question_focus(kind: Column | str, question: Column | str) -> Column:
    k, q = F.lower(F.coalesce(_c(kind), F.lit(""))), F.lower(_c(question))
    return (
        F.when(k.contains("counting") | q.contains("how many"), "counting")
        .when(k.contains("comparison"), "comparison")
        .when(k.contains("attribute"), "specific_time")
        .when(q.rlike("when|what year|what date"), "specific_time")
        .when(q.rlike("how long|duration"), "duration")
        .when(q.rlike("before|after|first|last"), "temporal_ordering")
        .otherwise("specific_time")
    )


def reasoning_focus(kind: Column | str) -> Column:
    k = F.lower(F.coalesce(_c(kind), F.lit("general")))
    return F.when(k.contains("order"), "order").when(k.contains("duration"), "duration").when(k.contains("compare"), "change_over_time").otherwise("specific_time")


def is_cross_period(focus: Column | str, query: Column | str) -> Column:
    return (F.coalesce(_c(focus), F.lit("")) == "trends_changes_and_cross_period") | F.coalesce(F.lower(_c(query)).rlike("since|over the last|changed|trend|evolution|compare"), F.lit(False))


def period_anchors(cross: Column, anchors: Column) -> tuple[Column, Column]:
    """First and last anchor of a cross-period query with at least two, else blank."""
    ok = cross & (F.size(anchors) >= 2)
    return F.when(ok, F.get(anchors, F.lit(0))).otherwise(""), F.when(ok, F.get(anchors, F.size(anchors) - 1)).otherwise("")


# JSON


def loose_json(text: Column | str) -> Column:
    """The JSON object in a model's answer: code fences are cut off, then the first { to the last }."""
    t = F.trim(F.regexp_replace(F.trim(_c(text)), r"^```[A-Za-z]*\s*|\s*```$", ""))
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(t.startswith("{") & t.endswith("}"), t).when(inner != "", inner).otherwise("{}")


def json_answer(text: Column | str, schema: str) -> Column:
    return F.from_json(loose_json(text), schema)


# Text


def tidy(items: Column) -> Column:
    """Trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def numbered_context(docs: Column, limit: int = 8000) -> Column:
    """Documents under numbered headings, cut to limit characters."""
    return F.substring(F.array_join(F.transform(docs, lambda x, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("]\n"), x)), "\n\n"), 1, limit)


def instructed(instruction: str, text: Column | str) -> Column:
    return F.concat(F.lit(instruction), _c(text))


def first_words(text: Column | str, n: int) -> Column:
    """About the first n tokens of a text."""
    return F.array_join(F.slice(F.split(F.trim(_c(text)), r"\s+"), 1, n), " ")


def safe(x: Column | str, default: float = 0.0) -> Column:
    """A number, or a default for null and NaN."""
    return F.coalesce(F.nanvl(_c(x), F.lit(None).cast("double")), F.lit(default))


def is_blank(x: Column | str) -> Column:
    c = _c(x)
    return c.isNull() | (F.length(c) == 0)


# Prices a thousand tokens, of prompts and of answers, by a part of the model's name.
PRICES = {"gpt-3.5": (0.0005, 0.0015), "claude-3-opus": (0.015, 0.075)}
DEFAULT_PRICE = (0.0025, 0.01)


def tokens_of_chars(n: Column | str) -> Column:
    return F.floor(_c(n) / 4)


def cost(model: Column | str, prompt: Column | str, answer: Column | str) -> Column:
    m = F.coalesce(_c(model), F.lit(""))
    a, b = (F.lit(x) for x in DEFAULT_PRICE)
    for part, (x, y) in PRICES.items():
        a, b = F.when(m.contains(part), x).otherwise(a), F.when(m.contains(part), y).otherwise(b)
    return F.coalesce(_c(prompt), F.lit(0)) / 1000.0 * a + F.coalesce(_c(answer), F.lit(0)) / 1000.0 * b
