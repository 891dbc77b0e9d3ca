"""Token-ID output: files of compressed id arrays with a shared dictionary.

Format.  A store is a folder with two Parquet tables, which any store that Spark reaches can hold:

  dictionary  one row: hash (sha256), raw (a zstandard dictionary, or empty), id_bytes (2 or 4), end_id
  shards      a row for each run of documents in order of id: first_doc, last_doc, part, seq, n_docs,
              n_tokens, dict_hash, doc_ids and ends (packed int64; ends are offsets into payload), and
              payload: one zstandard frame for each document, of its little-endian ids

The dictionary is trained on the serialized id arrays of a bounded sample of documents (the SAMPLE_DOCS ids that hash
lowest, at most SAMPLE_BYTES of each).  Documents are compressed one by one, so a short one is read alone by its offsets
(``read_document``), and none can be read with another dictionary: every shard names the hash of its own.

Texts are dealt by ranges of (id, hash of text) and sorted within a range; equal ids with different
texts are in hash order.  Ranges come from a sample of the rows, so a hot source is no hot range; shards
are bounded by SHARD_BYTES.  Where a tokenizer's declared parts drop case and white space and split letters from the rest,
no token spans white space or the end of a run of letters before something else, so a worker has each distinct word encoded
once by the library and remembers it (at most CACHE words, and CHUNKS of what stands between white space; the later half
goes when there are more).  With other tokenizers, the library encodes whole texts.

Defined results: a null or empty text is its end id alone; rows with a null id come first and have a null id; repeated
rows are stored row by row; an empty table is a store without shards; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice, pairwise
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

SHARD_BYTES = 4 << 20
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16 << 10, 64 << 10
CACHE, CHUNKS = 400_000, 500_000
RUN = 1024
LEVEL = 3
_SHARD = pa.schema([("first_doc", pa.int64()), ("last_doc", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("dict_hash", pa.string()), ("doc_ids", pa.binary()), ("ends", pa.binary()), ("payload", pa.binary())])
SHARD = "first_doc long, last_doc long, part int, seq int, n_docs long, n_tokens long, dict_hash string, doc_ids binary, ends binary, payload binary"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _caches(path: str, dtype: str) -> tuple[tuple[dict[str, bytes], dict[str, bytes]], dict[bytes, bytes]]:
    """Serialized ids of words and of rests, and of chunks as they stand in texts."""
    return ({}, {}), {}


def _byte_letters() -> list[str]:
    """The letters that byte-level vocabularies write bytes as: printable ones as they are, the others as
    the letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_BYTE = _byte_letters()


#: The declared parts (JSON) of tokenizers that drop case and white space and split letters from the rest.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


@lru_cache(maxsize=2)
def _by_words(path: str) -> bool:
    """Whether the tokenizer's declared parts let texts be cut at white space, and a run of letters from what
    follows it: then words and rests are encoded apart.  Others encode whole texts."""
    t = _tokenizer(path)
    if t.normalizer is None or t.pre_tokenizer is None or t.post_processor is not None or type(t.model).__name__ != "BPE":
        return False
    declared = [json.loads(part.__getstate__()).get(name) for part, name in ((t.normalizer, "normalizers"), (t.pre_tokenizer, "pretokenizers"))]
    special = t.get_added_tokens_decoder().values()
    plain = all(x.content.startswith("<") and not re.search(r"\s", x.content) and not (x.lstrip or x.rstrip or x.single_word) for x in special)
    return declared == [_NORMALIZER, _SPLITTER] and plain and not (t.model.dropout or t.model.continuing_subword_prefix or t.model.ignore_merges)


#: A run of lower-case letters that normalizers leave alone, then ASCII: of ASCII chunks, and of others.
_ASCII = re.compile(r"(?m)^([a-z]*)(.*)$")
_LATIN = re.compile(r"(?m)^([a-z\u00df-\u00f6\u00f8-\u00ff\u0101\u0103\u0105\u0107\u0111\u0113\u0115\u0117\u0119\u011b\u0142\u0144\u0148\u0151\u0153\u0159\u015b\u0161\u0163\u0165\u016b\u016f\u0171\u017a\u017c\u017e]*)([\x21-\x7e]*)$|^.*$")


def _pieces(chunks: Iterable[bytes]) -> Iterator[tuple[bytes, str, str]]:
    """(chunk, word, rest): the ids of a chunk are those of the word and of the rest, both in lower case where that
    is safe; a chunk that can't be cut is all rest.  Special tokens are looked for in the text as it stands."""
    plain, latin, odd = [], [], []
    for c in chunks:
        (odd if b"<" in c else plain if c.isascii() else latin).append(c)
    if plain:
        yield from zip(plain, *zip(*_ASCII.findall(b"\n".join(plain).decode().lower()), strict=True), strict=True)
    if latin:
        text = b"\n".join(latin).decode("utf-8", "replace")
        whole, low = text.split("\n"), text.lower()
        if not is_normalized("NFC", text):
            low = "\n".join([t.lower() if is_normalized("NFC", t) else "" for t in whole])
        for c, t, (w, r) in zip(latin, whole, _LATIN.findall(low), strict=True):
            yield (c, w, r) if w else (c, "", t)
    for c in odd:
        yield c, "", c.decode("utf-8", "replace")


def _forget(cache: dict, most: int) -> None:
    """Of more than ``most`` entries, the later half: what was met first is met most often."""
    if len(cache) > most:
        while len(cache) > most // 2:
            cache.popitem()


class Encoder:
    """Texts (UTF-8) to serialized ids, each with the end id.

    A tokenizer that works word by word (_by_words) has each distinct word encoded once by its model; what
    stands between white space is remembered, at most CHUNKS of it, of which the later half goes when there is more."""

    def __init__(self, path: str, id_bytes: int, end_id: int):
        self.path, self.dtype = path, f"<u{id_bytes}"
        self.end = np.array([end_id], self.dtype).tobytes()
        self.code = {2: "H", 4: "I"}[id_bytes]

    def _bytes(self, ids: list[int]) -> bytes:
        a = array(self.code, ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def _library(self, texts: list[str]) -> Iterator[bytes]:
        for lo in range(0, len(texts), 4096):
            for e in _tokenizer(self.path).encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False):
                yield self._bytes(e.ids)

    def _learn(self, chunks: set[bytes]) -> None:
        """Make the ids of chunks known."""
        (words, rests), known = _caches(self.path, self.dtype)
        split = list(_pieces(chunks))
        for cache in (words, rests):
            _forget(cache, CACHE)
        new = list({r for _, _, r in split}.difference(rests))
        rests.update(zip(new, self._library(new), strict=True))
        tokenize, code = _tokenizer(self.path).model.tokenize, self._bytes
        for w in {w for _, w, _ in split}.difference(words):
            letters = w if w.isascii() else "".join([_BYTE[b] for b in w.encode()])
            words[w] = code([t.id for t in tokenize(letters)]) if w else b""
        for c, w, r in split:
            known[c] = words[w] + rests[r] if r else words[w]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """texts: strings or UTF-8 bytes, without nulls."""
        try:
            texts = texts.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
        if not _by_words(self.path):
            return [x + self.end for x in self._library(texts.to_pylist())]
        known = _caches(self.path, self.dtype)[1]
        parts = pc.ascii_split_whitespace(texts)
        places = parts.flatten().dictionary_encode()
        chunks = places.dictionary.cast(pa.binary()).to_pylist()
        _forget(known, CHUNKS)
        self._learn(set(chunks).difference(known))  # walks the batch, not the cache
        ids = pa.array([*map(known.__getitem__, chunks)], pa.binary()).take(places.indices)
        at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset :][parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
        raw = memoryview(ids.buffers()[2]) if at[-1] else b""
        return [b"".join((raw[x:y], self.end)) for x, y in pairwise(at)]


def id_bytes(path: str) -> int:
    return 2 if _tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, encoder: Encoder) -> bytes:
    """A zstandard dictionary of the serialized ids of SAMPLE_DOCS documents, those with the lowest hash
    of their id; empty where there is too little to learn from."""
    picked = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_BYTES] for x in encoder(b.column("text"))], pa.binary())], names=["ids"])

    own = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # SAMPLE_DOCS rows at most
    samples = sorted(bytes(r["ids"]) for r in own.select("text").mapInArrow(C.tidy(encode), "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(docs: DataFrame, path: str, out: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encode all documents by the tokenizer in path and write a store to out."""
    spark = docs.sparkSession
    rows = C.texts(docs, key, text)
    encoder = Encoder(path, id_bytes(path), end_id)
    raw = train_dictionary(rows, encoder)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw), id_bytes(path), end_id)], "hash string, raw binary, id_bytes int, end_id long").coalesce(1).write.parquet(f"{out}/dictionary")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(spark.sparkContext.defaultParallelism, -(-size // (32 << 20)))
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # lists of words without any cycle, which collections would walk again and again
        codec = _codec(raw)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=codec, write_content_size=True) if codec else zstandard.ZstdCompressor(level=LEVEL)
        part, seq, ids, frames, held, tokens = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def flush():
            ends = np.cumsum(np.fromiter(map(len, frames), np.int64, len(frames)))
            return C.batch_of(_SHARD, [(ids[0], ids[-1], part, seq, len(ids), tokens, digest, C.pack_ids(ids), C.pack(ends), b"".join(frames))])

        for b in batches:
            for i, x in zip(b.column("doc_id").to_pylist(), encoder(b.column("text")), strict=True):
                ids.append(i)
                frames.append(press.compress(x))
                held += len(frames[-1])
                tokens += len(x) // encoder_bytes
                if held >= SHARD_BYTES:
                    yield flush()
                    seq, ids, frames, held, tokens = seq + 1, [], [], 0, 0
            del b
            pa.default_memory_pool().release_unused()
        if ids:
            yield flush()
        gc.enable()

    encoder_bytes = id_bytes(path)
    ordered.mapInArrow(C.tidy(shards), SHARD).write.parquet(f"{out}/shards")


class Store:
    """A written store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        d = spark.read.parquet(f"{path}/dictionary").first()
        self.raw, self.hash, self.id_bytes, self.end_id = bytes(d["raw"]), d["hash"], d["id_bytes"], d["end_id"]
        if hashlib.sha256(self.raw).hexdigest() != self.hash:
            raise ValueError(f"{path}: the dictionary doesn't match its hash")

    def shards(self) -> DataFrame:
        """With start: the ids of all shards before, by sums within parts, within runs of RUN parts, and over runs:
        one row a run is all that one task gets."""
        s = self.spark.read.schema(SHARD).parquet(f"{self.path}/shards")
        before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        each = s.select("part", "seq", F.col("n_tokens").alias("n"))
        parts = each.groupBy("part").agg(F.sum("n").alias("n")).withColumn("run", F.floor(F.col("part") / RUN))
        runs = parts.groupBy("run").agg(F.sum("n").alias("n")).select("run", before(Window.orderBy("run")).alias("a"))
        parts = parts.select("part", "run", before(Window.partitionBy("run").orderBy("part")).alias("b")).join(runs, "run")
        start = each.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("c")).join(parts, "part")
        return s.join(start.select("part", "seq", F.expr("a + b + c").alias("start")), ["part", "seq"])

    def _open(self):
        raw, dtype, want = self.raw, f"<u{self.id_bytes}", self.hash

        def load(row: dict) -> Iterator[tuple[int, np.ndarray]]:
            if row["dict_hash"] != want:
                raise ValueError(f"a shard asks for dictionary {row['dict_hash']}")
            codec = _codec(raw)
            unpress = zstandard.ZstdDecompressor(dict_data=codec) if codec else zstandard.ZstdDecompressor()
            payload, at = row["payload"], 0
            for i, end in zip(C.unpack_ids(row["doc_ids"]).to_pylist(), C.unpack(row["ends"], np.int64).tolist(), strict=True):
                yield i, np.frombuffer(unpress.decompress(payload[at:end]), dtype)
                at = end

        return load

    def digests(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document."""
        load = self._open()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    out, start = [], row["start"]
                    for i, ids in load(row):
                        out.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        C.bounded_batches(self.spark)
        return self.shards().mapInArrow(C.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")

    def documents(self) -> DataFrame:
        """doc_id and ids of every document."""
        load = self._open()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    documents = load(row)
                    while some := list(islice(documents, 256)):
                        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([ids.astype(np.int64) for _, ids in some], pa.list_(pa.int64()))], names=["doc_id", "ids"])

        C.bounded_batches(self.spark)
        return self.spark.read.schema(SHARD).parquet(f"{self.path}/shards").mapInArrow(C.tidy(run), "doc_id long, ids array<long>")

    def read_document(self, doc_id: int) -> list[list[int]]:
        """The ids of the documents with this id, decompressing nothing else of their shards."""
        reaches = (F.coalesce("first_doc", F.lit(doc_id)) <= doc_id) & (F.col("last_doc") >= doc_id)  # rows without an id come first
        rows = self.spark.read.schema(SHARD).parquet(f"{self.path}/shards").where(reaches).orderBy("part", "seq")
        codec, out = _codec(self.raw), []
        unpress = zstandard.ZstdDecompressor(dict_data=codec) if codec else zstandard.ZstdDecompressor()
        for r in rows.toLocalIterator():
            ids, ends = C.unpack_ids(bytes(r["doc_ids"])).to_pylist(), [0, *C.unpack(bytes(r["ends"]), np.int64).tolist()]
            for i in (k for k, x in enumerate(ids) if x == doc_id):
                out.append(np.frombuffer(unpress.decompress(bytes(r["payload"][ends[i] : ends[i + 1]])), f"<u{self.id_bytes}").tolist())
        return out


def new_path(spark: SparkSession) -> str:
    """A fresh folder in the shared one."""
    return f"{C.shared(spark)}/id-store-{uuid.uuid4().hex}"
