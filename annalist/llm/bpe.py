"""Byte-level BPE: encoding by a global shuffle of distinct words, and decoding.

The text is split by the tokenizer's pattern; blocks (see blocks.py) keep the pre-tokens of their
documents in order, as positions in the block's distinct words.  Each block sends its distinct words to
buckets of words; a bucket encodes each distinct word of the corpus once and answers with ids, which
are joined back by block and put together by position.  Blocks are made twice, for the words and for the
join, which is cheaper than keeping them; should a block come out otherwise the second time (an input that
isn't read in the same order), its fingerprint differs from that of its answers and it encodes its
own words.  Decoding joins the token-byte table (as many
rows as the vocabulary) to the ids.

Defined results: a null or empty text has no ids; a null id stays null; repeated rows are encoded row by row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C

REQUEST = "bucket int, block_id long, print long, places binary, word_lengths binary, words binary"
REPLY = "block_id long, print long, places binary, id_lengths binary, word_ids binary"
_REQUEST = pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("print", pa.int64()), ("places", pa.binary()), ("word_lengths", pa.binary()), ("words", pa.binary())])
_REPLY = pa.schema([("block_id", pa.int64()), ("print", pa.int64()), ("places", pa.binary()), ("id_lengths", pa.binary()), ("word_ids", pa.binary())])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _pieces(path: str) -> tiktoken.Encoding:
    """Takes each text as one piece."""
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=load_ranks(path), special_tokens={})


#: Patterns are run by the faster ``re`` on texts whose letters are all below this one.
NARROW = 0x250
#: Words that are put together at a time.
SOME = 100_000
_KNOWN = re.compile(r"\\p\{[LN]\}|\\[sS]|\\?.", re.S)


def narrow(pattern: str) -> re.Pattern | None:
    """The pattern in the syntax of ``re``, with \\p{L}, \\p{N}, \\s and \\S spelled out for letters below NARROW; None if it
    has other escapes, options or nested classes."""
    spelled = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        of = regex.compile(name)
        spelled[name] = "".join(rf"\u{i:04x}" for i in range(NARROW) if of.match(chr(i)))
    out, inside = [], False
    for m in _KNOWN.finditer(pattern):
        t = m[0]
        if t in spelled or t == r"\S":
            if t == r"\S" and inside:
                return None
            out.append(spelled[t] if inside else f"[^{spelled[chr(92) + 's']}]" if t == r"\S" else f"[{spelled[t]}]")
            continue
        if t[0] == "\\" or (t == "[" and inside) or (t == "?" and out[-1:] == ["("] and pattern[m.end()] not in "!:="):
            return None
        inside = t == "[" or (inside and t != "]")
        out.append(t)
    return re.compile("".join(out))


_WIDE = re.compile(rf"[^\x00-{chr(NARROW - 1)}]")


def splitter(pattern: str):
    """Texts to the matches of a pattern."""
    wide, fast = regex.compile(pattern), narrow(pattern)

    def split(raw: bytes) -> list[str]:
        text = raw.decode("utf-8", "replace")
        return (wide if fast is None or _WIDE.search(text) else fast).findall(text)

    return split


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[bytes, ...]:
    """The token-byte table: its size is the vocabulary's."""
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        table[i] = raw
    return tuple(table)


@lru_cache(maxsize=2)
def _token_table(path: str) -> pa.Array:
    return pa.array(token_bytes(path), pa.large_binary())


def fingerprint(block: dict) -> int:
    return xxhash.xxh3_64_intdigest(block["word_lengths"] + block["words"]) >> 1


def _ask(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            for b in batches:
                for row in b.to_pylist():
                    words, own = B.Block(row).words, fingerprint(row)
                    bucket = np.array([xxhash.xxh3_64_intdigest(w) % n for w in words], np.int64)
                    order = np.argsort(bucket, kind="stable")
                    at = B.split(bucket[order], n)
                    for i in np.flatnonzero(np.diff(at)).tolist():
                        mine = order[at[i] : at[i + 1]]
                        yield (i, row["block_id"], own, C.pack(mine.astype(np.uint32), 1), *C.pack_words([words[j] for j in mine.tolist()]))

        yield from C.emit(items(), _REQUEST)

    return run


def _encode_bucket(path: str):
    def run(table: pa.Table) -> pa.Table:
        encode, known, out = _pieces(path).encode_ordinary, {}, []
        for i in range(table.num_rows):
            row = {n: table.column(n)[i].as_py() for n in table.column_names}
            ids = []
            for w in C.unpack_words(row["word_lengths"], row["words"]):
                if (got := known.get(w)) is None:
                    known[w] = got = encode(w.decode())
                ids.append(got)
            flat = [x for got in ids for x in got]
            out.append((row["block_id"], row["print"], row["places"], C.pack(np.fromiter(map(len, ids), np.uint32, len(ids))), C.pack(np.array(flat, np.uint32))))
        return pa.Table.from_batches([C.batch_of(_REPLY, out)])

    return run


def word_ids(replies: list[dict], n_words: int) -> list[list[int]]:
    """For each distinct word of the block, its ids."""
    out: list[list[int] | None] = [None] * n_words
    for r in replies:
        ids, ends = C.unpack(r["word_ids"], np.uint32).tolist(), np.cumsum(C.unpack(r["id_lengths"], np.uint32), dtype=np.int64).tolist()
        start = 0
        for place, end in zip(C.unpack(r["places"], np.uint32).tolist(), ends, strict=True):
            out[place] = ids[start:end]
            start = end
    if None in out:
        raise RuntimeError("a word of the block has no ids")
    return out


def per_document(docs: DataFrame, path: str, pattern: str, finish, schema: str, arrow: pa.Schema, key: str = "doc_id", text: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """finish(doc_ids, lengths, places of words, ids of words) -> pa.Table, called for each block."""
    split = None

    def tokenize(raw: bytes) -> list[str]:
        nonlocal split
        split = split or splitter(pattern)  # compiled where it runs
        return split(raw)

    blocks = B.plan(docs, tokenize, block_bytes, key, text)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(C.column(text).cast("string"))), F.lit(0))).first()[0]
    asked = blocks.mapInArrow(C.tidy(_ask(B.buckets(size, 8 << 20))), REQUEST)
    replies = C.checkpoint(asked.groupBy("bucket").applyInArrow(C.tidy(_encode_bucket(path)), REPLY))
    mine = ["doc_ids", "lengths", "ids", "word_lengths", "words"]
    theirs = ["print", "places", "id_lengths", "word_ids"]
    none = lambda df, cols: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols]
    both = blocks.select("block_id", *mine, *none(replies, theirs)).unionByName(replies.select("block_id", *none(blocks, mine), *theirs))

    def join(table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        out = []
        for block in (r for r in got if r["doc_ids"] is not None):
            words, own = C.unpack_words(block["word_lengths"], block["words"]), fingerprint(block)
            answers = [r for r in got if r["doc_ids"] is None and r["print"] == own]
            if words and not answers:
                ids = [_pieces(path).encode_ordinary(w.decode()) for w in words]
            else:
                ids = word_ids(answers, len(words))
            out.append(finish(C.unpack_ids(block["doc_ids"]), C.unpack(block["lengths"], np.uint32).tolist(), C.unpack(block["ids"], np.uint32), ids))
        return pa.concat_tables(out) if out else arrow.empty_table()

    return both.groupBy("block_id").applyInArrow(C.tidy(join), schema)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""

    def finish(doc_ids, lengths, places, ids):
        out, at = [], 0
        for n in lengths:
            out.append([x for p in places[at : at + n].tolist() for x in ids[p]])
            at += n
        return pa.table([doc_ids, pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return per_document(docs, path, pattern, finish, "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), key, text)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, raw binary: the bytes of the ids, by the token-byte table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_table(path)
        for b in batches:
            ids = pc.fill_null(b.column("ids"), [])
            raw = table.take(ids.flatten())
            ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1)[ids.offsets.to_numpy() - ids.offsets[0].as_py()].tolist()
            data = memoryview(raw.buffers()[2] or b"")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bytes(data[x:y]) for x, y in pairwise(ends)], pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(C.tidy(run), "doc_id long, raw binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts, encoded and decoded again."""

    def finish(doc_ids, lengths, places, ids):
        shown = [",".join(map(str, got)).encode() for got in ids]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        first = np.cumsum(size) - size
        words = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        table, n, a, b = _token_table(path), [], [], []
        bounds = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
        lo = 0
        while lo < len(lengths):  # documents of SOME words at a time, or one
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SOME, "right")) - 1)
            at = places[bounds[lo] : bounds[hi]].astype(np.int64)
            # the ids in order, and where each document's end
            count = size[at]
            ends = np.cumsum(count)
            flat = words[np.repeat(first[at] - (ends - count), count) + np.arange(int(count.sum()))]
            cuts = bounds[lo : hi + 1] - bounds[lo]
            starts = np.concatenate([[0], ends])[cuts]
            # decoding: each id joined to the bytes of its token
            raw = table.take(pa.array(flat))
            data = memoryview(raw.buffers()[2] or b"")
            n.append(np.diff(starts))
            b += [hashlib.sha256(data[x:y]).hexdigest() for x, y in pairwise(np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1)[starts].tolist())]
            mine = at.tolist()
            a += [hashlib.sha256(b",".join([shown[p] for p in mine[x:y]])).hexdigest() for x, y in pairwise(cuts.tolist())]
            lo = hi
        return pa.table([doc_ids, pa.array(np.concatenate(n)), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return per_document(docs, path, pattern, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]), key, text)
