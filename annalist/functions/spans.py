"""Temporal expressions with their places in a text: an Arrow function, as no built-in gives offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# The kinds of expressions and their patterns.
KINDS = {
    "year": r"\b(19\d{2}|20\d{2})\b",
    "date": r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\w+ \d{1,2},? \d{4}|\d{1,2} \w+ \d{4})\b",
    "duration": r"\b(\d+\s*(?:years?|months?|weeks?|days?|hours?|minutes?|decades?|centuries?))\b",
    "relative": r"\b(recently|today|yesterday|last\s+\w+|next\s+\w+|current|nowadays|now|present)\b",
    "range": r"\b(from\s+\d{4}\s+to\s+\d{4}|\d{4}\s*[-–—]\s*\d{4})\b",
}
_KINDS = {k: re.compile(p, re.I) for k, p in KINDS.items()}
_OUT = pa.struct([("text", pa.string()), ("kind", pa.string()), ("normalized", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())])


def find(text: str | None) -> list[dict]:
    """In order of their starts, kinds in order at the same start; overlaps stay."""
    found = [{"text": m[0], "kind": k, "normalized": m[0] if k == "year" else None, "start_pos": m.start(), "end_pos": m.end()} for k, p in _KINDS.items() for m in p.finditer(text or "")]
    return sorted(found, key=lambda x: x["start_pos"])


def spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, kind, normalized, start_pos, end_pos: a row for each expression."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([find(t) for t in b.column(1).to_pylist()], pa.list_(_OUT))], names=[key, "spans"])

    kept = df.select(key, text)
    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, spans array<struct<text:string,kind:string,normalized:string,start_pos:int,end_pos:int>>").select(key, F.inline("spans"))


def has_temporal_content(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.rlike("|".join(f"(?i:{p})" for p in KINDS.values())), F.lit(False))
