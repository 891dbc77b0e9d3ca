"""Helpers that the operators of this subpackage share: checkpoints, Arrow batches, codecs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Upper bounds of one Arrow batch on its way to Python.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096
PLAN_CHARS = 4096


def _lean() -> None:
    """Large arrays are mapped and go back to the system when they are dropped, where the C library allows it."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


_lean()


def trim() -> None:
    """Idle workers hold no memory that they don't use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """For functions of batches or of one group: trim when they are done."""

    def batches(given):
        try:
            yield from run(given)
        finally:
            trim()

    def group(table):
        try:
            return run(table)
        finally:
            trim()

    return batches if inspect.isgeneratorfunction(run) else group


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.  Only a session on one machine may
    do without, in a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that lost executors cost a re-read, not a re-run.  Shuffles of plans that
    have ended are dropped at once."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared(spark))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    drop()
    written = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", PLAN_CHARS)  # the driver keeps a plan's text for each time that it is planned anew
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", written)


def drop() -> None:
    """On the driver: let handles of plans and arrays go that nothing refers to any more."""
    gc.collect(1)
    trim()


def forget(*checkpoints: DataFrame) -> None:
    """Delete the files of checkpoints that nothing reads any more."""
    for df in checkpoints:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


def delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame) -> Column:
    """All columns of df as one, ``row``: beside it no name can clash."""
    return F.struct(*map(column, df.columns)).alias("row")


def bounded_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: send them this package, and bound Arrow batches by bytes as
    well as by rows, as rows may be very long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text as UTF-8 bytes, a null text as an empty one."""
    bounded_batches(df.sparkSession)
    return df.select(column(key).cast("long").alias("doc_id"), F.coalesce(column(text).cast("string"), F.lit("")).cast("binary").alias("text"))


def rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def pack(a: np.ndarray, level: int = 3) -> bytes:
    """Numbers as zstandard-compressed byte planes (planes compress better than whole integers)."""
    a = np.ascontiguousarray(a)
    if a.dtype.itemsize > 1 and len(a):
        a = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T)
    return zstandard.ZstdCompressor(level=level, write_content_size=True).compress(a.tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    raw, dtype = zstandard.ZstdDecompressor().decompress(blob), np.dtype(dtype)
    if dtype.itemsize == 1 or not raw:
        return np.frombuffer(raw, dtype)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_ids(ids: list[int | None]) -> bytes:
    """Numbers, some of them null: the places of nulls go before the rest."""
    gaps = np.flatnonzero([i is None for i in ids]).astype(np.int64)
    return len(gaps).to_bytes(8, "little") + gaps.tobytes() + pack(np.array([i or 0 for i in ids], np.int64))


def unpack_ids(blob: bytes) -> pa.Array:
    n = int.from_bytes(blob[:8], "little")
    values = unpack(blob[8 + 8 * n :], np.int64)
    mask = np.zeros(len(values), bool)
    mask[np.frombuffer(blob[8 : 8 + 8 * n], np.int64)] = True
    return pa.array(values, mask=mask)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as the first one and gaps, four bytes each where all gaps fit."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    small = bool((gaps < np.uint64(1 << 32)).all())
    return (b"4" if small else b"8") + int(keys[0]).to_bytes(8, "little") + pack(gaps.astype(np.uint32 if small else np.uint64), 1)


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    gaps = unpack(blob[9:], np.uint32 if blob[:1] == b"4" else np.uint64)
    return np.cumsum(np.concatenate([np.array([int.from_bytes(blob[1:9], "little")], np.uint64), gaps.astype(np.uint64)]), dtype=np.uint64)


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    """Byte strings as (compressed lengths, compressed bytes)."""
    return pack(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpack_words(lengths: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(unpack(lengths, np.uint32), dtype=np.int64).tolist()
    raw = zstandard.ZstdDecompressor().decompress(data)
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def mix64(a: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads its input over all bits."""
    a = a.astype(np.uint64)
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and for each element the place of its value there."""
    order = np.argsort(a)
    ranked = a[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(a) else np.empty(0, bool)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(first) - 1
    return ranked[first], place


def batch_of(schema: pa.Schema, out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)


def emit(items: Iterable[tuple], schema: pa.Schema, n: int = 2048, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most n rows and about size bytes of binary values."""
    out, held = [], 0
    for x in items:
        out.append(x)
        held += sum(len(v) for v in x if isinstance(v, (bytes, str)))
        if len(out) >= n or held >= size:
            yield batch_of(schema, out)
            out, held = [], 0
    if out:
        yield batch_of(schema, out)
