"""LM scoring by deleted interpolation.

The maximum-likelihood estimates of orders 1..n are mixed level by level,

    P_k(w | h) = a_k(b) * c(h, w) / c(h) + (1 - a_k(b)) * P_{k-1}(w | shorter h),    P_0 = 1 / (V + 1),

where the weight a_k depends on the bucket b (whole powers of two) of the context's frequency c(h) and
is learned by expectation-maximisation on held-out counts: one fold of the training documents (``held``)
is kept out of the counts that the weights are fitted with (the deleted part) and added to the counts
with which texts are scored.  A context that was never seen leaves all weight to the shorter one.

Dataflow.  Documents become blocks (see blocks.py); each block sends the distinct hashed n-grams of
all orders with their counts to buckets of keys; buckets sum and answer; the answers are joined back
by block, as the counts of all places and the events of the held-out fold, which EM reduces to histograms of bounded size (context bucket x
two binned log probabilities), and finally scores its documents.  n-gram keys are 64-bit hashes; n-grams of
order 2 and up keep 40 bits of theirs within a bucket of some millions of keys, at any size of the corpus.

Defined results: a null or empty text is one end token; a null id stays null and is in the fold of an empty text; repeated
rows are scored, and learned from, row by row; an empty table has an empty result; without any training
document c = N = V = 0 and the base score of a token is log10(0.1 / 0.1).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C

END, START = b"\n", b" "  # words hold no white space, so these can't be words
N_CONTEXT, N_BINS, BIN = 24, 256, 8.0  # context buckets; bins of -log2(p), 1/BIN octave each
REQUEST = "bucket int, block_id long, level int, keys binary, main binary, held binary"
REPLY = "block_id long, bucket int, level int, main binary, total binary"
COUNTED = "doc_ids binary, folds binary, lengths binary, counts binary, events binary"
SCORES = "doc_id long, fold int, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ARROW = {
    "request": pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("main", pa.binary()), ("held", pa.binary())]),
    "reply": pa.schema([("block_id", pa.int64()), ("bucket", pa.int32()), ("level", pa.int32()), ("main", pa.binary()), ("total", pa.binary())]),
    "scores": pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]),
}


def tokenize(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, without the end token."""
    return text.lower().split()


def fold_of(doc_ids: pa.Array, folds: int) -> np.ndarray:
    """A null id counts as an empty text."""
    return np.array([zlib.crc32(b"" if i is None else b"%d" % i) % folds for i in doc_ids.to_pylist()], np.int32)


def spare_bits(n_buckets: int) -> int:
    """Bits cut from the keys of orders above 1: within a bucket 40 remain, however many buckets."""
    return max(0, 24 - (n_buckets - 1).bit_length())


class Grams:
    """The n-gram keys of a block.  keys[k - 1] has, for each place of the stream, the key of the
    k-gram that ends there; level 0 of context() is the number of all tokens."""

    def __init__(self, block: B.Block, order: int, folds: int, n_buckets: int):
        words, spare = block.words, spare_bits(n_buckets)
        word_keys = np.array([xxhash.xxh3_64_intdigest(w) for w in [*words, END, START]], np.uint64)
        end, start = len(words), len(words) + 1
        pad = max(1, order - 1)
        n, lengths = len(block.lengths), block.lengths + pad + 1
        first = np.cumsum(lengths) - lengths
        stream = np.full(int(lengths.sum()), start, np.int64)
        self.doc = np.repeat(np.arange(n), lengths)
        place = np.arange(len(stream)) - first[self.doc]
        inside = (place >= pad) & (place < lengths[self.doc] - 1)
        stream[inside] = block.ids
        stream[first + lengths - 1] = end
        self.real = place >= pad
        self.counted = place >= pad - 1  # with the last start mark, the context of a text's first token
        h = word_keys[stream]
        self.keys, last = [h], h
        for k in range(2, order + 1):
            longer = np.zeros_like(h)
            longer[1:] = last[:-1]
            last = C.mix64(longer * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(k))
            self.keys.append(last >> np.uint64(spare))
        self.fold = fold_of(block.doc_ids, folds)
        self.lengths, self.n = block.lengths + 1, n
        self.is_start = stream == start


def _bucket(keys: np.ndarray, n: int, level: int) -> np.ndarray:
    """Ascending with ascending keys: the top 32 bits scaled to n."""
    top = keys >> np.uint64(32 - (spare_bits(n) if level > 1 else 0))
    return (top * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _requests(order: int, folds: int, excluded: int, held: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            for b in batches:
                for row in b.to_pylist():
                    g = Grams(B.Block(row), order, folds, n)
                    train, aside = (m[g.doc][g.counted] for m in ((g.fold != excluded) & (g.fold != held), g.fold == held))
                    for k in range(1, order + 1):
                        keys, at = C.distinct(g.keys[k - 1][g.counted])
                        main, late = (np.bincount(at[m], minlength=len(keys)).astype(np.uint32) for m in (train, aside))
                        at = B.split(_bucket(keys, n, k), n)
                        for i in np.flatnonzero(np.diff(at)).tolist():
                            s = slice(at[i], at[i + 1])
                            yield i, row["block_id"], k, C.pack_sorted(keys[s]), C.pack(main[s], 1), C.pack(late[s], 1)

        yield from C.emit(items(), _ARROW["request"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """All requests for one bucket and one order: sum over blocks, reply to each block in its order."""
    got = table.to_pylist()
    keys = [C.unpack_sorted(r["keys"]) for r in got]
    main = [C.unpack(r["main"], np.uint32) for r in got]
    late = [C.unpack(r["held"], np.uint32) for r in got]
    every = np.unique(np.concatenate(keys))
    sums = np.zeros((2, len(every)), np.int64)
    for k, m, h in zip(keys, main, late, strict=True):
        at = np.searchsorted(every, k)
        sums[0, at] += m
        sums[1, at] += h
    sums[1] += sums[0]
    known = sums[:, every != np.uint64(xxhash.xxh3_64_intdigest(START))]
    out = []
    for r, k in zip(got, keys, strict=True):
        at = np.searchsorted(every, k)
        out.append((r["block_id"], r["bucket"], r["level"], C.pack(sums[0, at].astype(np.uint64), 1), C.pack(sums[1, at].astype(np.uint64), 1)))
    # what the corpus holds of order 1 goes along as a row of its own
    if got[0]["level"] == 1:
        out.append((-1, got[0]["bucket"], 0, C.pack(np.array([known[1].sum(), (known[1] > 0).sum(), known[0].sum()], np.uint64)), b""))
    return pa.Table.from_batches([C.batch_of(_ARROW["reply"], out)])


class Counts:
    """The corpus counts of the n-grams that end at each counted place of a block."""

    def __init__(self, counted: np.ndarray, at: list[np.ndarray]):
        self.counted, self.at = counted, at
        self.full = []
        for a in at:
            self.full.append(np.zeros(len(counted), np.int64))
            self.full[-1][counted] = a

    @classmethod
    def of(cls, g: Grams, replies: list[dict], order: int, columns: list[str]) -> list[Counts]:
        out: list[list] = [[] for _ in columns]
        for k in range(1, order + 1):
            mine = sorted((r for r in replies if r["level"] == k), key=lambda r: r["bucket"])
            keys, at = C.distinct(g.keys[k - 1][g.counted])
            for x, c in zip(out, columns, strict=True):
                count = np.concatenate([C.unpack(r[c], np.uint64) for r in mine]).astype(np.int64)
                if len(count) != len(keys):
                    raise RuntimeError(f"block: {len(keys)} keys of order {k}, {len(count)} answers")
                x.append(count[at])
        return [cls(g.counted, x) for x in out]

    def gram(self, k: int, where: np.ndarray) -> np.ndarray:
        return self.full[k - 1][where]

    def context(self, k: int, where: np.ndarray) -> np.ndarray:
        """How often the first k - 1 tokens of the k-gram were seen."""
        return self.full[k - 2][where - 1]


def _log_bin(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.floor(-np.log2(np.where(p > 0, p, 1)) * BIN), N_BINS - 2), N_BINS - 1).astype(np.int64)


def _context_bin(c: np.ndarray) -> np.ndarray:
    """0: never seen; b: 2^(b-1) <= c < 2^b."""
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0), N_CONTEXT - 1).astype(np.int64)


def _mixed(grams: list[np.ndarray], contexts: list[np.ndarray], n: int, v: int, weights: list[np.ndarray]) -> np.ndarray:
    """P_k of all events, for as many levels as there are weights."""
    p = np.full(len(grams[0]), 1.0 / (v + 1))
    for k, a in enumerate(weights, 1):
        c = contexts[k - 1] if k > 1 else np.full(len(p), n)
        b = _context_bin(c) if k > 1 else np.zeros(len(p), np.int64)
        w = np.where(c > 0, a[b], 0.0)
        p = w * (grams[k - 1] / np.maximum(c, 1)) + (1 - w) * p
    return p


def learn_weights(hist: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM for one level.  hist: (context bucket, bin of the estimate, bin of the shorter one) -> events."""
    ml = 2.0 ** -((np.arange(N_BINS) + 0.5) / BIN)
    ml[N_BINS - 1] = 0.0
    low = 2.0 ** -((np.arange(N_BINS) + 0.5) / BIN)
    out = np.full(N_CONTEXT, 0.5)
    for b in range(N_CONTEXT):
        i, j = np.nonzero(hist[b])
        if len(i):
            n, x, y, a = hist[b][i, j], ml[i], low[j], 0.5
            for _ in range(rounds):
                a = float((n * (a * x / (a * x + (1 - a) * y))).sum() / n.sum())
            out[b] = min(max(a, 1e-6), 1 - 1e-6)
    return out


def score(docs: DataFrame, order: int = 3, folds: int = 10, excluded: int = 0, held: int = 9, key: str = "doc_id", text: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Score all texts with a model of ``order`` learned from all documents whose fold,
    crc32(id as text) mod folds, is not ``excluded``.  Columns: see SCORES; log10 probabilities."""
    blocks = B.build(docs, tokenize, block_bytes, key, text)
    tokens, words = blocks.agg(F.coalesce(F.sum(F.col("n_tokens") + F.col("n_docs")), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    n = B.buckets(tokens * order)
    replies = C.checkpoint(blocks.mapInArrow(C.tidy(_requests(order, folds, excluded, held, n)), REQUEST).groupBy("bucket", "level").applyInArrow(C.tidy(_answer), REPLY))
    # one row for each bucket of order 1
    total, v, main = replies.where("block_id = -1").mapInArrow(C.tidy(_totals), "n long, v long, main long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "main"))).first()
    own = [c for c in blocks.columns if c != "block_id"]
    answer = ["bucket", "level", "main", "total"]
    joined = blocks.select("block_id", *own, *(F.lit(None).cast(replies.schema[c].dataType).alias(c) for c in answer)).unionByName(replies.where("block_id >= 0").select("block_id", *(F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in own), *answer))
    counted = C.checkpoint(joined.groupBy("block_id").applyInArrow(C.tidy(_join(order, folds, held, n)), COUNTED))
    C.forget(blocks, replies)
    events = counted.select("events")
    weights: list[np.ndarray] = []
    for k in range(1, order + 1):
        hist = np.zeros(N_CONTEXT * N_BINS * N_BINS, np.float64)
        cells = events.mapInArrow(C.tidy(_histogram(order, k, main, v, weights)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        for cell, count in cells.collect():  # at most N_CONTEXT * N_BINS ** 2 rows, whatever the corpus
            hist[cell] = count
        weights.append(learn_weights(hist.reshape(N_CONTEXT, N_BINS, N_BINS)))
    return counted.drop("events").mapInArrow(C.tidy(_score(order, total, v, weights)), SCORES)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [C.unpack(x, np.uint64) for x in b.column("main").to_pylist()]
        yield pa.RecordBatch.from_pydict({"n": pa.array([int(x[0]) for x in got], pa.int64()), "v": pa.array([int(x[1]) for x in got], pa.int64()), "main": pa.array([int(x[2]) for x in got], pa.int64())})


def _join(order: int, folds: int, held: int, n_buckets: int):
    """Of each block, the counts at all places, and the events of the held-out fold with the counts of
    the others."""

    def run(table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        block = B.Block(next(r for r in got if r["doc_ids"] is not None))
        g = Grams(block, order, folds, n_buckets)
        main, total = Counts.of(g, [r for r in got if r["doc_ids"] is None], order, ["main", "total"])
        where = np.flatnonzero(g.real & (g.fold == held)[g.doc])
        columns = [main.gram(k, where) for k in range(1, order + 1)] + [main.context(k, where) for k in range(2, order + 1)]
        cells = [C.pack_ids(block.doc_ids.to_pylist()), C.pack(g.fold), C.pack(g.lengths), C.pack(np.concatenate(total.at), 1), C.pack(np.concatenate(columns), 1)]
        return pa.table({c: pa.array([x], pa.binary()) for c, x in zip(("doc_ids", "folds", "lengths", "counts", "events"), cells, strict=True)})

    return run


def _histogram(order: int, level: int, n: int, v: int, weights: list[np.ndarray]):
    weights = list(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist: dict[int, int] = {}
        for b in batches:
            for blob in b.column("events").to_pylist():
                a = C.unpack(blob, np.int64)
                cols = a.reshape(2 * order - 1, -1)
                grams, contexts = cols[:order], [None, *cols[order:]]
                c = contexts[level - 1] if level > 1 else np.full(cols.shape[1], n)
                p = grams[level - 1] / np.maximum(c, 1)
                low = _mixed(grams, contexts, n, v, weights)
                seen = c > 0
                bucket = _context_bin(c) if level > 1 else np.zeros(len(c), np.int64)
                cell = ((bucket * N_BINS + _log_bin(p)) * N_BINS + _log_bin(low))[seen]
                for x, y in zip(*(z.tolist() for z in np.unique(cell, return_counts=True)), strict=True):
                    hist[x] = hist.get(x, 0) + y
        yield pa.RecordBatch.from_pydict({"cell": pa.array(list(hist), pa.int64()), "n": pa.array(list(hist.values()), pa.int64())})

    return run


def _score(order: int, n: int, v: int, weights: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                doc_ids, fold, lengths = C.unpack_ids(row["doc_ids"]), C.unpack(row["folds"], np.int32), C.unpack(row["lengths"], np.int64)
                # the counted places of a document: its last start mark and its tokens
                c = Counts(np.ones(int((lengths + 1).sum()), bool), list(C.unpack(row["counts"], np.int64).reshape(order, -1)))
                doc = np.repeat(np.arange(len(lengths)), lengths)
                where = np.arange(len(doc)) + doc + 1
                grams = [c.gram(k, where) for k in range(1, order + 1)]
                p = _mixed(grams, [None, *(c.context(k, where) for k in range(2, order + 1))], n, v, weights)
                base = np.log10((grams[0] + 0.1) / (n + 0.1 * (v + 1)))
                add = lambda x: np.bincount(doc, weights=x, minlength=len(lengths))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(fold), pa.array(lengths), pa.array(add(grams[0] > 0).astype(np.int64)), pa.array(np.full(len(doc_ids), n, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))], schema=_ARROW["scores"])

    return run
