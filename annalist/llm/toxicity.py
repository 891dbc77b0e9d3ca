"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as an embedding of its own (words of the training sample, else none) beside the mean embedding
of its character n-grams with word ends; gated recurrent units read windows of WINDOW words from both
sides, attention pools their states, and a logistic unit gives the window's score.  A document's score
is the largest over all its overlapping windows (STRIDE words apart), whatever its length: WINDOW - STRIDE words that
follow each other always stand together in some window.  Gates
and states are squashed by x / (1 + |x|), which costs no transcendental function.

Training: labels come by document, so windows are learned as instances of bags.  The sample is bounded: TRAIN_DOCS
documents of each label, those whose id hashes lowest, without texts of over TRAIN_BYTES; all windows of the others are
learned from, STEPS batches an epoch.  All windows first count with the label of their document; then only the
highest-scoring windows of toxic documents count as toxic, beside all windows of clean documents.  The network (some
530,000 numbers, most of them embeddings of character n-grams, and D_WORD for each word of the sample) is trained on the driver
and sent to executors; documents are scored where they are read: nothing is shuffled.

Defined results: a null, empty or blank text scores 0; repeated rows are scored row by row; without
labels of both kinds to learn from, all scores are 0; labels of unknown documents and null labels are ignored; an id with
clashing labels counts as toxic; a null id has no label, and is in the fold of an empty text; an empty table gives an empty
result; other columns are ignored by ``classify`` and kept apart by ``with_scores``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common as C

WINDOW, STRIDE = 32, 24
TRAIN_DOCS, TRAIN_BYTES = 2000, 32 << 10
STEPS = 48  # batches of an epoch, whatever the sample's size
D_WORD, D_CHAR, H, D_ATT = 8, 8, 8, 8
BUCKETS = 1 << 16  # of character n-grams
GRAMS = (3, 4, 5, 6)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def normal(chunk: bytes) -> bytes:
    """A chunk between white space in lower case and without punctuation around it."""
    return _EDGE.sub("", chunk.decode("utf-8", "replace").lower()).encode()


class Grams:
    """Buckets of the character n-grams of words, as a ragged array."""

    def __init__(self, words: list[bytes]):
        raw = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        word = np.repeat(np.arange(len(words)), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(raw))  # bytes to the word's end
        buckets, owners = [], []
        h = np.zeros(len(raw), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            nxt = np.zeros(len(raw), np.uint64)
            nxt[: len(raw) - n + 1] = raw[n - 1 :]
            h = h * np.uint64(0x100000001B3) + nxt + np.uint64(1)
            if n in GRAMS:
                ok = left >= n
                buckets.append((C.mix64(h[ok] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
                owners.append(word[ok])
        bucket, owner = np.concatenate(buckets), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.bucket, self.owner = bucket[order], owner[order]
        self.count = np.bincount(self.owner, minlength=len(words))
        self.first = np.cumsum(self.count) - self.count

    def mean(self, table: np.ndarray) -> np.ndarray:
        """Mean embeddings of the words."""
        out = np.zeros((len(self.count), table.shape[1]), np.float32)
        some = self.count > 0
        if len(self.bucket):
            out[some] = np.add.reduceat(table[self.bucket], self.first[some], axis=0)
        return out / np.maximum(self.count[:, None], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Model:
    """Parameters by name, float32.  Row 0 of ``word`` is for words outside the vocabulary."""

    def __init__(self, vocabulary: list[bytes], seed: int = 0):
        r = np.random.default_rng(seed)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        f = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        d = D_WORD + D_CHAR
        self.p = {"word": f(len(vocabulary) + 1, D_WORD, s=0.05), "char": f(BUCKETS, D_CHAR, s=0.02), "att": f(2 * H, D_ATT, s=0.3), "v": f(D_ATT, s=0.3), "out": f(2 * H, s=0.3), "bias": np.array([-1.0], np.float32)}
        self.p["word"][0] = 0
        for side in "fb":
            self.p |= {f"x{side}": f(d, 3 * H, s=0.4), f"u{side}": f(H, 3 * H, s=0.3), f"c{side}": np.zeros(3 * H, np.float32)}

    def lookup(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))

    @staticmethod
    def _squash(x: np.ndarray) -> np.ndarray:
        """In place."""
        d = np.abs(x)
        d += 1
        return np.divide(x, d, out=x)

    def _side(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, steps, keep: list | None) -> np.ndarray:
        """States (steps, windows, H); x: projected inputs (steps, windows, 3 H)."""
        h = np.zeros((x.shape[1], H), np.float32)
        out = np.empty((x.shape[0], x.shape[1], H), np.float32)
        whole = mask.all(1)
        for t in steps:
            g = h @ u
            zr = self._squash(x[t, :, : 2 * H] + g[:, : 2 * H])
            zr += 1
            zr *= np.float32(0.5)
            z, r = zr[:, :H], zr[:, H:]
            n = self._squash(x[t, :, 2 * H :] + r * g[:, 2 * H :])
            new = h - n
            new *= z
            new += n
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * H :]))
            if not whole[t]:
                new = np.where(mask[t][:, None], new, h)
            out[t] = h = new
        return out

    def forward(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of windows; mask (steps, windows): where a word stands."""
        p, w = self.p, len(xf)
        kf, kb = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._side(xf, mask, p["uf"], range(w), kf), self._side(xb, mask, p["ub"], range(w - 1, -1, -1), kb)], 2)
        a = self._squash(h @ p["att"])
        e = np.where(mask, a @ p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = (weight[:, :, None] * h).sum(0)
        y = _sigmoid(pooled @ p["out"] + p["bias"])
        if keep is not None:
            keep |= {"kf": kf, "kb": kb, "h": h, "a": a, "weight": weight, "pooled": pooled}
        return y

    def inputs(self, words: list[bytes], size: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Projected inputs of distinct words from both sides."""
        f, b = (np.empty((len(words), 3 * H), np.float32) for _ in range(2))
        for lo in range(0, len(words), size):
            some = words[lo : lo + size]
            x = np.concatenate([self.p["word"][self.lookup(some)], Grams(some).mean(self.p["char"])], 1)
            f[lo : lo + size] = x @ self.p["xf"] + self.p["cf"]
            b[lo : lo + size] = x @ self.p["xb"] + self.p["cb"]
        return f, b

    def scores(self, places: np.ndarray, xf: np.ndarray, xb: np.ndarray, size: int = 4096) -> np.ndarray:
        """Scores of windows of places of distinct words (windows, WINDOW); -1: no word."""
        out = []
        for lo in range(0, len(places), size):
            at = np.ascontiguousarray(places[lo : lo + size].T)
            out.append(self.forward(xf[at], xb[at], at >= 0))
        return np.concatenate(out) if out else np.empty(0, np.float32)

    def gradients(self, ids: np.ndarray, grams: Grams, places: np.ndarray, target: np.ndarray, weight: np.ndarray, drop: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the weighted cross entropy of windows, by backpropagation through time."""
        p, mask = self.p, places.T >= 0
        at = np.ascontiguousarray(places.T)
        known = np.where(drop, 0, ids)
        x = np.concatenate([p["word"][known], grams.mean(p["char"])], 1)
        k: dict = {}
        y = self.forward((x @ p["xf"] + p["cf"])[at], (x @ p["xb"] + p["cb"])[at], mask, k)
        loss = float(-(weight * (target * np.log(y + 1e-7) + (1 - target) * np.log(1 - y + 1e-7))).sum() / weight.sum())
        dy = (weight * (y - target) / weight.sum()).astype(np.float32)
        g = {"out": k["pooled"].T @ dy, "bias": np.array([dy.sum()], np.float32)}
        dpool = dy[:, None] * p["out"]
        dh = k["weight"][:, :, None] * dpool
        dw = (k["h"] * dpool).sum(2)
        de = k["weight"] * (dw - (k["weight"] * dw).sum(0))
        g["v"] = np.einsum("twd,tw->d", k["a"], de)
        da = de[:, :, None] * p["v"] * (1 - np.abs(k["a"])) ** 2
        g["att"] = np.einsum("twh,twd->hd", k["h"], da)
        dh = dh + da @ p["att"].T
        dx = np.zeros_like(x)
        by_word = np.argsort(at.ravel(), kind="stable")
        by_word = by_word[np.count_nonzero(at < 0) :]
        uses = at.ravel()[by_word]
        first = np.flatnonzero(np.concatenate([[True], uses[1:] != uses[:-1]]))
        for side, kept, part in (("f", k["kf"], dh[:, :, :H]), ("b", k["kb"], dh[:, :, H:])):
            u, du = p[f"u{side}"], np.zeros((H, 3 * H), np.float32)
            flow = np.zeros((places.shape[0], H), np.float32)
            dproj, here = np.zeros((len(ids), 3 * H), np.float32), np.empty((*at.shape, 3 * H), np.float32)
            for t, h, z, r, n, gn in reversed(kept):
                d = (part[t] + flow) * 1.0
                live = mask[t][:, None]
                dn = np.where(live, d * (1 - z) * (1 - np.abs(n)) ** 2, 0)
                dz = np.where(live, d * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2, 0)
                dr = dn * gn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                back = np.concatenate([dz, dr, dn * r], 1)
                du += h.T @ back
                flow = np.where(live, d * z, d) + back @ u.T
                here[t] = np.concatenate([dz, dr, dn], 1)
            dproj[uses[first]] = np.add.reduceat(here.reshape(-1, 3 * H)[by_word], first, axis=0)
            g[f"u{side}"], g[f"c{side}"] = du, dproj.sum(0)
            g[f"x{side}"] = x.T @ dproj
            dx += dproj @ p[f"x{side}"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], known, dx[:, :D_WORD])
        g["word"][0] = 0
        dc = (dx[:, D_WORD:] / np.maximum(grams.count[:, None], 1))[grams.owner]
        g["char"] = np.stack([np.bincount(grams.bucket, weights=dc[:, c], minlength=BUCKETS) for c in range(D_CHAR)], 1).astype(np.float32)
        return g, loss


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k, x in self.p.items():
            m, s = self.m[k], self.s[k]
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] * g[k] - s)
            x -= (self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(s / (1 - 0.99**self.n)) + 1e-7)).astype(np.float32)


def window_starts(n: int) -> range:
    """All overlapping windows of n words: every STRIDE words, the last one up to the end."""
    return range(0, max(n - WINDOW, 0) + STRIDE if n > WINDOW else 1, STRIDE)


class Sample:
    """Labelled documents as arrays of places in one list of words."""

    def __init__(self):
        self.words, self.labels, self.texts = _Index(), [], []

    def add(self, label: int, words: list[bytes]) -> None:
        if words:
            self.labels.append(label)
            self.texts.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))

    @classmethod
    def of(cls, rows: Iterable[tuple[int, list[bytes]]]) -> Sample:
        out = cls()
        for label, words in rows:
            out.add(label, words)
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """All windows of all documents (-1: no word), and whose they are."""
        starts = [window_starts(len(t)) for t in self.texts]
        bag = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
        out = np.full((len(bag), WINDOW), -1, np.int32)
        i = 0
        for t, ss in zip(self.texts, starts, strict=True):
            for s in ss:
                w = t[s : s + WINDOW]
                out[i, : len(w)] = w
                i += 1
        return out, bag


def train(sample: Sample, epochs: int = 7, batch: int = 512, seed: int = 0) -> Model | None:
    """None without both labels.  An epoch is STEPS batches; windows are dealt in turn, so those that an epoch doesn't
    reach come first in the next one."""
    if len(set(sample.labels)) < 2:
        return None
    r = np.random.default_rng(seed)
    words = list(sample.words)
    seen = np.bincount(np.concatenate([np.unique(t) for t in sample.texts]), minlength=len(words))
    model = Model([w for w, n in zip(words, seen.tolist(), strict=True) if n >= 3], seed)
    ids = model.lookup(words)
    windows, bag = sample.windows()
    label = np.array(sample.labels, np.float32)[bag]
    size = np.bincount(bag)
    opt = Adam(model.p, 0.01)
    # small samples take as many steps as large ones
    turn = {(y, "all"): np.flatnonzero(label == y) for y in (0, 1)}
    turn |= {y: r.permutation(turn[y, "all"]) for y in (0, 1)}
    for epoch in range(epochs):
        weight = np.ones(len(windows), np.float32)
        if epoch >= 2:  # the windows that make a document toxic
            y = model.scores(windows, *model.inputs(words))
            rank = np.zeros(len(windows), np.int64)
            order = np.lexsort((-y, bag))
            rank[order] = np.arange(len(windows)) - np.repeat(np.cumsum(size) - size, size)
            most = np.maximum(1, size[bag] // (4 if epoch < 4 else 10))
            weight[(label > 0) & (rank >= most)] = 0
            weight[(label == 0) & (rank == 0)] = 3
        balance = weight[label == 0].sum() / max(weight[label > 0].sum(), 1)
        weight[label > 0] *= np.float32(min(balance, 10) / 2)
        n = int((weight > 0).sum())
        size_of = min(batch, max(64, n // STEPS))
        share = {y: max(1, round(size_of * int((weight[label == y] > 0).sum()) / n)) for y in (0, 1)}
        for _ in range(STEPS):
            rows = np.concatenate([_deal(turn, y, weight, k, r) for y, k in share.items()])
            used, at = np.unique(windows[rows], return_inverse=True)
            at = at.reshape(len(rows), WINDOW)
            if used[0] < 0:
                used, at = used[1:], at - 1
            mine = Grams([words[j] for j in used.tolist()])
            drop = r.random(len(used)) < 0.3
            g, _ = model.gradients(ids[used], mine, at, label[rows], weight[rows], drop)
            opt.step(g)
        opt.rate *= 0.75
    del opt, windows, turn
    C.drop()
    return model


def _deal(turn: dict, y: int, weight: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    """The next k windows of label y with a weight; a new deal when all have had their turn."""
    out, n = [], 0
    while n < k:
        if not len(turn[y]):
            turn[y] = r.permutation(turn[y, "all"])
        hand = turn[y][: 4 * k]
        ok = np.flatnonzero(weight[hand] > 0)[: k - n]
        out.append(hand[ok])
        n += len(ok)
        turn[y] = turn[y][(ok[-1] + 1 if n == k else len(hand)) :]
    return np.concatenate(out)


def fold_of(key, folds: int):
    """crc32 of the id as text, mod folds; a null id counts as an empty text."""
    text = (C.column(key) if isinstance(key, str) else key).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS, key: str = "doc_id", text: str = "text", label: str = "toxic", where=None) -> Sample:
    """Of each label, at most per_label ids, those that hash lowest; of their texts those of at most TRAIN_BYTES, whole.
    An id with clashing labels counts as toxic; of its texts, if there are several, the least one counts."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    known = labels.select(C.column(key).alias("doc_id"), C.column(label).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    if where is not None:
        known = known.where(where)
    picked = None
    for y in (0, 1):
        # the ids alone: at most per_label rows
        one = known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = one if picked is None else picked.unionByName(one)
    texts = C.texts(docs, key, text).where(F.octet_length("text") <= TRAIN_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor()
        for b in batches:
            words = [press.compress(b" ".join([w for w in map(normal, raw.split()) if w])) for raw in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(words, pa.binary())], names=["doc_id", "label", "words"])

    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(C.tidy(cut), "doc_id long, label int, words binary").collect()  # 2 * per_label rows at most
    got.sort(key=lambda r: r["doc_id"])
    unpress = zstandard.ZstdDecompressor()
    return Sample.of((r["label"], unpress.decompress(bytes(r["words"])).split()) for r in got)


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = docs.select(C.column(key).cast("long").alias("doc_id"), C.column(text).alias("text"))
    return with_scores(rows, model).select("row.doc_id", "score")


def with_scores(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """row (all columns of docs, whatever their names) and score."""
    C.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(C.whole(docs), F.coalesce(C.column(text).cast("string"), F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = sent.value
        for b in batches:
            raw = b.column("raw").to_pylist()
            best = np.zeros(len(raw), np.float64) if m is None else _best(m, raw)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(best)], names=["row", "score"])

    return rows.mapInArrow(C.tidy(run), StructType([rows.schema["row"], StructField("score", DoubleType())]))


class _Index(dict):
    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self)
        return n


def _best(m: Model, raw: list[bytes]) -> np.ndarray:
    """The largest window score of each text."""
    index = _Index()
    chunks = [t.split() for t in raw]
    ids = np.fromiter(map(index.__getitem__, chain.from_iterable(chunks)), np.int64)
    doc = np.repeat(np.arange(len(raw)), np.fromiter(map(len, chunks), np.int64, len(chunks)))
    del chunks
    words = list(map(normal, index))
    word_of = _Index()
    place = np.fromiter(map(word_of.__getitem__, words), np.int64, len(words))
    named = np.array([bool(w) for w in words], bool)
    ids, doc = (ids[named[ids]], doc[named[ids]]) if len(ids) else (ids, doc)
    out = np.zeros(len(raw), np.float64)
    if not len(ids):
        return out
    distinct = list(word_of)
    xf, xb = m.inputs(distinct)
    at = place[ids]
    count = np.bincount(doc, minlength=len(raw))
    first = np.cumsum(count) - count
    n_windows = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(raw)), n_windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    step = 8192
    for lo in range(0, len(owner), step):
        o = owner[lo : lo + step]
        inside = nth[lo : lo + step, None] * STRIDE + np.arange(WINDOW)
        ok = inside < count[o][:, None]
        windows = np.where(ok, at[np.minimum(first[o][:, None] + inside, len(at) - 1)], -1)
        np.maximum.at(out, o, m.scores(windows, xf, xb))
    return out


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted.  Rows of the held-out fold, crc32(id as text) mod folds,
    are not learned from."""
    model = train(sample(docs, labels, key=key, text=text, where=fold_of("doc_id", folds) != held_out))
    return score(docs, model, key, text).select("doc_id", (fold_of("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
