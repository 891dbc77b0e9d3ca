"""Blocks: some megabytes of neighbouring documents, tokenised against a vocabulary of their own.

A block is one row: document ids, tokens per document, the tokens as indexes into the block's
distinct words, and those words.  Operators that must look up every word or n-gram of the corpus in a
global table send each block's *distinct* keys only, in one row for each (bucket of keys, block), and
get one row back: the shuffle holds distinct keys of blocks, not tokens, and a hot key appears at most
once for each block however many rows hold it.  The number of buckets follows the corpus, so that
neither side of the exchange outgrows a task.  ``build`` checkpoints blocks: their contents never
change when executors are lost.  ``plan`` leaves that out, for users that can do with blocks that
come out otherwise when they are made again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common as C

BLOCK_BYTES = 8 << 20
SCHEMA = "block_id long, n_docs long, n_tokens long, n_words long, doc_ids binary, lengths binary, ids binary, word_lengths binary, words binary"
_ARROW = pa.schema([("block_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_words", pa.int64())] + [(n, pa.binary()) for n in ("doc_ids", "lengths", "ids", "word_lengths", "words")])


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def build(df: DataFrame, tokenize: Callable[[bytes], list], block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Checkpointed blocks of df.  tokenize gives a text's tokens (bytes or str) in order."""
    return C.checkpoint(plan(df, tokenize, block_bytes, key, text))


def plan(df: DataFrame, tokenize: Callable[[bytes], list], block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of df, made again by whatever reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        ids, lengths, chunks, size, vocab = [], [], [], 0, _Vocabulary()

        def flush():
            words = [w if isinstance(w, bytes) else w.encode() for w in vocab]
            tokens = np.concatenate(chunks) if chunks else np.empty(0, np.uint32)
            return (part << 32 | n, len(ids), len(tokens), len(words), C.pack_ids(ids), C.pack(np.array(lengths, np.uint32)), C.pack(tokens), *C.pack_words(words))

        for doc_id, raw in C.rows(batches, "doc_id", "text"):
            tokens = tokenize(raw)
            # ids come in order of first sight: small numbers for frequent words
            chunks.append(np.fromiter(map(vocab.__getitem__, tokens), np.uint32, len(tokens)))
            ids.append(doc_id)
            lengths.append(len(tokens))
            size += len(raw) + 16
            if size >= block_bytes:
                yield C.batch_of(_ARROW, [flush()])
                ids, lengths, chunks, size, vocab, n = [], [], [], 0, _Vocabulary(), n + 1
        if ids:
            yield C.batch_of(_ARROW, [flush()])

    return C.texts(df, key, text).mapInArrow(C.tidy(run), SCHEMA)


class Block:
    """One block, unpacked."""

    def __init__(self, row: dict):
        self.block_id = row["block_id"]
        self.doc_ids = C.unpack_ids(row["doc_ids"])  # of rows without an id: null
        self.lengths = C.unpack(row["lengths"], np.uint32).astype(np.int64)
        self.ids = C.unpack(row["ids"], np.uint32)
        self._words = row["word_lengths"], row["words"]

    @property
    def words(self) -> list[bytes]:
        return C.unpack_words(*self._words)


def buckets(keys: int, per_bucket: int = 3_000_000, least: int = 16) -> int:
    return max(least, -(-keys // per_bucket))


def split(bucket: np.ndarray, n: int) -> np.ndarray:
    """Bounds of buckets 0..n-1 in an ascending array of bucket numbers."""
    return np.searchsorted(bucket, np.arange(n + 1))
