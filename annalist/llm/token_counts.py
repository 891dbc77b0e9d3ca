"""Token counts of sections, by offset-mapped attribution.

Each document is encoded once, as a whole.  The ids' byte lengths give every token a span of bytes and so of
characters; token spans are joined to the spans of the document's sections by a merge of the two sorted
interval lists (each document's own, in its row).  A token that crosses a boundary is allocated by rule:

  first     to the section of its first character
  last      to the section of its last character
  majority  to the section with most of its bytes, the first of equals
  split     to each section in proportion to its bytes of the token (fractions)

Under each rule the counts of a document's sections add up to its token count.  Sections cover the text:
by default its lines, each with the line feed that ends it.  Fields (several columns) are sections of the
text they make when joined by a separator, which belongs to the field before it.

Defined results: a null or empty text has one empty section without tokens; a null id stays null; repeated rows are
counted row by row; an empty table gives an empty result; other columns are ignored.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import common as C

RULES = ("first", "last", "majority", "split")
_OUT = pa.schema([("doc_id", pa.int64()), ("section", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())])


@lru_cache(maxsize=2)
def _lengths(path: str) -> np.ndarray:
    return np.fromiter(map(len, bpe.token_bytes(path)), np.int64)


def line_sections(raw: bytes) -> np.ndarray:
    """Byte offsets at which the text's lines begin."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(raw)]])


def attribute(ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sections that begin at starts (bytes, ascending from 0) of a text of size bytes whose
    tokens end at ends; and of each section, the tokens that begin there and cross its end."""
    begins = np.concatenate([[0], ends])[:-1]
    a, b = (np.searchsorted(starts, x, "right") - 1 for x in (begins, ends - 1))
    n = len(starts)
    cross = np.bincount(a[a < b], minlength=n)
    if rule == "first":
        return np.bincount(a, minlength=n).astype(float), cross
    if rule == "last":
        return np.bincount(b, minlength=n).astype(float), cross
    out = np.bincount(a[a == b], minlength=n).astype(float)
    bounds = np.concatenate([starts, [size]])
    for t in np.flatnonzero(a < b).tolist():
        s = np.arange(a[t], b[t] + 1)
        part = np.minimum(bounds[s + 1], ends[t]) - np.maximum(bounds[s], begins[t])
        if rule == "majority":
            out[s[np.argmax(part)]] += 1
        else:
            out[s] += part / part.sum()
    return out, cross


def by_section(docs: DataFrame, path: str, pattern: str, rule: str = "first", sections=line_sections, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, section (from 0), start_char, end_char, n_tokens, n_crossing, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = bpe._encoding(path, pattern), _lengths(path)
        for b in batches:
            columns, nulls = [[] for _ in _OUT.names], []
            for doc_id, raw in C.rows([b], "doc_id", "text"):
                ends = np.cumsum(lengths[np.array(encode.encode_ordinary(raw.decode("utf-8", "replace")), np.int64)])
                starts = sections(raw)
                count, cross = attribute(ends, starts, len(raw), rule)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                at = chars[np.concatenate([starts, [len(raw)]])]
                n = len(starts)
                for c, x in zip(columns, (np.full(n, doc_id or 0), np.arange(n), at[:-1], at[1:], count, cross, np.full(n, len(ends))), strict=True):
                    c.append(x)
                nulls.append(np.full(n, doc_id is None))
            arrays = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(columns, _OUT.types, strict=True)]
            arrays[0] = pc.if_else(pa.array(np.concatenate(nulls) if nulls else [], pa.bool_()), pa.scalar(None, pa.int64()), arrays[0])
            yield pa.RecordBatch.from_arrays(arrays, schema=_OUT)

    return C.texts(docs, key, text).mapInArrow(C.tidy(run), "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long")


def by_field(rows: DataFrame, fields: list[str], path: str, pattern: str, rule: str = "first", separator: str = "\n", key: str = "doc_id") -> DataFrame:
    """Like by_section, for several text columns that are encoded as one text; section: the field's place."""
    sep = separator.encode()
    bounds = F.array(*(F.octet_length(F.coalesce(C.column(f), F.lit(""))) for f in fields))
    joined = rows.select(C.column(key).cast("long").alias("doc_id"), F.concat_ws(separator, *(F.coalesce(C.column(f), F.lit("")) for f in fields)).cast("binary").alias("text"), bounds.alias("sizes"))
    C.bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = bpe._encoding(path, pattern), _lengths(path)
        for b in batches:
            out = []
            for doc_id, raw, sizes in C.rows([b], "doc_id", "text", "sizes"):
                ends = np.cumsum(lengths[np.array(encode.encode_ordinary(raw.decode("utf-8", "replace")), np.int64)])
                starts = np.concatenate([[0], np.cumsum(np.array(sizes[:-1], np.int64) + len(sep))]).astype(np.int64)
                count, cross = attribute(ends, starts, len(raw), rule)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                at = chars[np.concatenate([starts, [len(raw)]])]
                out += [(doc_id, i, int(at[i]), int(at[i + 1]), float(count[i]), int(cross[i]), len(ends)) for i in range(len(starts))]
            yield C.batch_of(_OUT, out)

    return joined.mapInArrow(C.tidy(run), "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long")
