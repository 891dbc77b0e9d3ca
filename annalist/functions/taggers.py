"""Taggers: functions from texts to the years that they are about, by name.

``rules`` is the extraction of ``years`` and stays inside the JVM; others are registered as functions of a list of
texts and run on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import years

TAGGERS: dict[str, Callable[[list[str]], list[Iterable[int]]]] = {}


def register_tagger(name: str, tagger: Callable[[list[str]], list[Iterable[int]]]) -> None:
    TAGGERS[name.lower()] = tagger


def tagged(df: DataFrame, key: str, text: str, tagger: str = "rules") -> DataFrame:
    """key and years (sorted, distinct) of each row's text; a text that a tagger fails on has none."""
    if tagger.lower() == "rules":
        return df.select(key, years.explicit_years(text).alias("years"))
    if tagger.lower() not in TAGGERS:
        raise ValueError(f"no tagger named {tagger}; known: {', '.join(['rules', *sorted(TAGGERS)])}")
    ship(df.sparkSession)
    tag = TAGGERS[tagger.lower()]

    def one(t: str) -> list[int]:
        try:
            return sorted({int(y) for y in tag([t])[0]})
        except Exception:
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("t").to_pylist()]
            try:
                found = [sorted({int(y) for y in ys}) for ys in tag(texts)]
            except Exception:  # then text by text
                found = list(map(one, texts))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(found, pa.list_(pa.int32()))], names=[key, "years"])

    rows = df.select(key, F.col(text).alias("t"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, years array<int>")
