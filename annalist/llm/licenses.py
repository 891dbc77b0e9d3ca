"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into words (runs of letters and digits in lower case; ASCII letters fold).  Each template's
GRAM-word hashes are winnowed (the least of each WINNOW neighbours) into an inverted index from
fingerprint to (template, position).  A document's word hashes are looked up in it; hits that lie on nearly the
same diagonal (document position minus template position) of one template are a candidate.  The template is then
aligned with the document's words in a band around the diagonal (local alignment: matches 2, mismatches and gaps
-1); a report gives the share of the template's words that are matched and the span of characters.  A
band may hold a notice more than once: all its alignments that don't overlap are kept.  A
match of less than ``coverage`` is dropped; of overlapping reports the one with more matched words
stays (the first by template name among equals).

The index has as many entries as the templates have fingerprints: it is sent to executors whole.  Documents are
scanned where they are read, without a shuffle.

Defined results: a null or empty text has no match; a null id stays null; repeated rows are scanned row by row; of
equal matches the first template by name stays; an empty table or no template gives no match; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import common as C

GRAM, WINNOW, BAND, COVERAGE = 3, 2, 6, 0.8

#: Short notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
OUT = "doc_id long, license string, coverage double, n_matched long, start_char long, end_char long"
_OUT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())])


def _hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        out = C.mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
    return out


def winnow(g: np.ndarray, window: int) -> list[int]:
    """Places of the least hash of each window (the last of equals)."""
    if not len(g):
        return []
    return sorted({i + len(w) - 1 - int(np.argmin(w[::-1])) for i in range(max(1, len(g) - window + 1)) for w in [g[i : i + window]]})


class Index:
    """Fingerprints of templates; those of fewer words than a gram have one for the whole."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [[w for w in _WORD.findall(templates[n].encode().lower())] for n in self.names]
        posted = defaultdict(list)
        for t, words in enumerate(self.words):
            h = _hashes(words, {})
            n = min(GRAM, len(words))
            if n:
                g = _grams(h, n)
                for i in winnow(g, WINNOW):
                    posted[n, int(g[i])].append((t, i))
        self.by_size = {}
        for n in sorted({n for n, _ in posted}):
            keys = sorted(k for m, k in posted if m == n)
            self.by_size[n] = (np.array(keys, np.uint64), [posted[n, k] for k in keys])

    def candidates(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(template, diagonal), diagonals rounded to the band."""
        found = set()
        for n, (keys, lists) in self.by_size.items():
            g = _grams(h, n)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            for p in np.flatnonzero(keys[at] == g).tolist() if len(g) else ():
                for t, i in lists[at[p]]:
                    found.add((t, (p - i) // BAND * BAND))
        return found


def align(template: list[bytes], words: list[bytes], diagonal: int, least: float) -> list[tuple[int, int, int]]:
    """Matched words, and the first and last document word matched, of the local alignments around a diagonal that
    match ``least`` words, best first; of those that overlap, the better one."""
    lo = max(0, diagonal - BAND)
    hi = min(len(words), diagonal + len(template) + 2 * BAND)
    width = hi - lo
    if width <= 0:
        return []
    ends = []
    # of each cell: score, matched words, first matched word
    above = [(0, 0, -1)] * (width + 1)
    for i, t in enumerate(template):
        row = [(0, 0, -1)] * (width + 1)
        a, z = max(0, diagonal + i - BAND - lo), min(width, diagonal + i + 2 * BAND + 1 - lo)
        for j in range(a, z):
            s, m, f = above[j]
            same = words[lo + j] == t
            here = (s + 2, m + 1, f if m else lo + j) if same else (s - 1, m, f)
            here = max(here, (above[j + 1][0] - 1, *above[j + 1][1:]), (row[j][0] - 1, *row[j][1:]), key=lambda c: c[0])
            if here[0] > 0:
                row[j + 1] = here
                if same and here[1] >= least:
                    ends.append((*here, lo + j))
        above = row
    out: list[tuple[int, int, int]] = []
    for _, m, a, z in sorted(ends, key=lambda e: -e[0]):
        if all(z < x or a > y for _, x, y in out):
            out.append((m, a, z))
    return out


def _scan(index: Index, coverage: float, raw: bytes, known: dict[bytes, int]) -> list[tuple]:
    lower = raw.lower()
    words = _WORD.findall(lower)
    found = index.candidates(_hashes(words, known))
    if not found:
        return []
    hits = set()
    for t, d in found:
        size = len(index.words[t])
        hits |= {(-n, index.names[t], n / size, a, z) for n, a, z in align(index.words[t], words, d, coverage * size)}
    if not hits:
        return []
    spans = [m.span() for m in _WORD.finditer(lower)]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    out, taken = [], bytearray(len(words))
    for n, name, share, a, z in sorted(hits):
        if 1 not in taken[a : z + 1]:
            taken[a : z + 1] = b"\1" * (z + 1 - a)
            out.append((name, share, -n, int(chars[spans[a][0]]), int(chars[spans[z][1]])))
    return sorted(out, key=lambda x: x[3])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each notice found: see OUT."""
    return _apply(docs, templates, coverage, key, text, lambda doc_id, hits: [(doc_id, *x) for x in hits], OUT, _OUT)


_EACH = pa.schema([("doc_id", pa.int64()), ("n_licenses", pa.int64()), ("matches", pa.list_(pa.struct(list(_OUT)[1:])))])
EACH = "doc_id long, n_licenses long, matches array<struct<license:string,coverage:double,n_matched:bigint,start_char:bigint,end_char:bigint>>"


def per_document(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: n_licenses and matches, in order of their place."""
    names = _OUT.names[1:]
    return _apply(docs, templates, coverage, key, text, lambda doc_id, hits: [(doc_id, len(hits), [dict(zip(names, x, strict=True)) for x in hits])], EACH, _EACH)


def _apply(docs, templates, coverage, key, text, shape, schema: str, arrow: pa.Schema) -> DataFrame:
    index = Index(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            out = []
            for doc_id, raw in C.rows([b], "doc_id", "text"):
                if len(known) > 300_000:
                    known.clear()
                out += shape(doc_id, _scan(index, coverage, raw, known))
            yield C.batch_of(arrow, out)

    return C.texts(docs, key, text).mapInArrow(C.tidy(run), schema)
