"""n-gram Jaccard join by parity sketches.

Every document is the set of its distinct shingles (hashed to 64 bits).  Sizes fall into bands; a band has
k segments, and each shingle belongs to one segment and is XORed into that segment's 64-bit word, so a
document's sketch of a band is k words.  A shingle in one of two sets only can change one segment only:
the number of segments in which two sketches differ is at most the symmetric difference, and for a
Jaccard similarity of at least 4/5 with a smaller set of a shingles that is at most a/4.  With more segments
than that, two linked documents agree in some segment (pigeonhole); k is chosen so large that they agree
even in a segment which holds two shingles or more.  A document for which its own segments don't guarantee this
(short ones, mostly) also sends the shingles of its prefix: the first 0.2 n + 1 in hash order, one of which
two linked documents share, so the few pairs that both lack the guarantee meet there.

A document enters its own band and those below that hold sizes of at least 4/5 of its own.  Blocks of documents
send (key, document) to buckets of keys, copies of one set once a block.  Links are only needed up to the
components they make, so a group of m documents is not turned into its pairs.  A bucket joins its groups
to local clusters and emits for each member the pair with the cluster's first member, and the pairs of
neighbours in each group.  Pairs pass the size bound and the Hamming bound of a bit parity sketch, then the exact
similarity of the texts: first members, then those neighbours which are in different components by
then.  At last the keys are sent once more with the components: in a group with several components each pair
across them is held against the bounds (in squares of CHUNK x CHUNK members) and verified.  So every pair
that shares a key is verified or lies within one component already: no link between components is lost.

Defined results: letters A-Z count as lower case; a document of fewer than n words is one shingle; a null or empty
text or one without words has no shingles and is linked with nothing; a null id stays null, and its row's component is
the least id that there is among linked rows, else null; of repeated rows each has a result; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C

CHUNK = 512
SKETCH = 1024  # bits
_SALT = np.uint64(0x9E3779B97F4A7C15)


def tokenize(text: bytes) -> list[bytes]:
    return text.lower().split()


def band_starts(limit: int) -> list[int]:
    """Band b holds sizes from the b-th of these up to the next one."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * 1.25)))
    return out


_STARTS = np.array(band_starts(1 << 40), np.int64)


def segments(band: int) -> int:
    """Of a band whose smaller sets have at most u shingles: over 1.3 times the largest difference."""
    most = (int(_STARTS[band + 1]) - 1) // 4
    return math.ceil(1.3 * most) + 2 if most else 1


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct shingle hashes, ascending, of one document's word hashes."""
    if not len(h):
        return np.empty(0, np.uint64)
    size = min(n, len(h))
    s = np.full(len(h) - size + 1, np.uint64(size), np.uint64)
    for j in range(size):
        s = C.mix64(s * _SALT + h[j : len(h) - size + 1 + j])
    return np.unique(s)


def signatures(u: np.ndarray) -> tuple[np.ndarray, np.uint64, bytes]:
    """Keys, the hash of the whole set and its bit parity sketch."""
    n, x = len(u), C.mix64(u + np.uint64(0x51ED2701))
    whole = C.mix64(np.bitwise_xor.reduce(x, keepdims=True) + np.add.reduce(x, keepdims=True) * _SALT + np.uint64(n))[0]
    sketch = np.packbits((np.bincount((x & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()
    own = int(np.searchsorted(_STARTS, n, "right")) - 1
    low = int(np.searchsorted(_STARTS, -(-4 * n // 5), "right")) - 1
    keys, sure = [], True
    for band in range(low, own + 1):
        k = segments(band)
        seg = ((u >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        held = np.diff(first, append=n)
        full = held >= (2 if k > 1 else 1)
        keys.append(C.mix64((np.bitwise_xor.reduceat(x, first) ^ (seg[first] * _SALT + np.uint64(band)))[full]))
        sure &= int(full.sum()) > (n // 4 if band == own else min(2 * n // 9, (int(_STARTS[band + 1]) - 1) // 4))
    if not sure:
        keys.append(C.mix64(u[: n - -(-4 * n // 5) + 1] + np.uint64(7)))
    return np.unique(np.concatenate(keys)), whole, sketch


_SIGNED = pa.schema([("block_id", pa.int64()), ("n_keys", pa.int64()), ("doc_ids", pa.binary()), ("sizes", pa.binary()), ("nodes", pa.binary()), ("sketches", pa.binary()), ("keys", pa.binary()), ("members", pa.binary())])
SIGNED = "block_id long, n_keys long, doc_ids binary, sizes binary, nodes binary, sketches binary, keys binary, members binary"


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            for b in batches:
                for row in b.to_pylist():
                    block = B.Block(row)
                    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in block.words], np.uint64)[block.ids] if len(block.ids) else np.empty(0, np.uint64)
                    sizes, nodes, sketches, keys, members, seen, at = [], [], [], [], [], set(), 0
                    for i, m in enumerate(block.lengths.tolist()):
                        u = shingles(hashes[at : at + m], n)
                        at += m
                        sizes.append(len(u))
                        if not len(u):
                            nodes.append(0)
                            sketches.append(bytes(SKETCH // 8))
                            continue
                        k, whole, sketch = signatures(u)
                        nodes.append(int(whole))
                        sketches.append(sketch)
                        if nodes[-1] not in seen:
                            seen.add(nodes[-1])
                            keys.append(k)
                            members.append(np.full(len(k), i, np.uint32))
                    k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
                    who = np.concatenate(members) if members else np.empty(0, np.uint32)
                    order = np.argsort(k, kind="stable")
                    yield (block.block_id, len(k), C.pack_ids(block.doc_ids.to_pylist()), C.pack(np.array(sizes, np.uint32)), C.pack(np.array(nodes, np.uint64)), b"".join(sketches), C.pack(k[order], 1), C.pack(who[order], 1))

        yield from C.emit(items(), _SIGNED, n=16)

    return run


_ROW = pa.schema([("doc_id", pa.int64()), ("ref", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("sketch", pa.binary())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document.  ref: its block and place there."""
    for b in batches:
        for r in b.to_pylist():
            ids, sizes, w = C.unpack_ids(r["doc_ids"]), C.unpack(r["sizes"], np.uint32), SKETCH // 8
            for a in range(0, len(ids), 4096):
                z = min(len(ids), a + 4096)
                yield pa.RecordBatch.from_arrays([ids[a:z], pa.array(_refs(r["block_id"], np.arange(a, z))), pa.array(C.unpack(r["nodes"], np.uint64)[a:z].view(np.int64)), pa.array(sizes[a:z].astype(np.int64)), pa.array([r["sketches"][i * w : i * w + w] for i in range(a, z)], pa.binary())], schema=_ROW)


def _refs(block_id: int, places: np.ndarray) -> np.ndarray:
    """Partition, block of it and place in it, in 24, 16 and 24 bits."""
    return ((np.int64(block_id >> 32) << np.int64(40)) | (np.int64(block_id & 0xFFFF) << np.int64(24))) | places.astype(np.int64)


_POSTED = pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("keys", pa.binary()), ("members", pa.binary()), ("labels", pa.binary())])
POSTED = "bucket int, block_id long, keys binary, members binary, labels binary"


def _post(n: int):
    """Keys by bucket; with ``known`` (place, label) of some documents, theirs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare = np.uint64(max(0, 24 - (n - 1).bit_length()))

        def items():
            for b in batches:
                for r in b.to_pylist():
                    keys, who, label = C.unpack(r["keys"], np.uint64), C.unpack(r["members"], np.uint32), None
                    if r["known"] is not None:
                        table = dict((x["place"], x["label"]) for x in r["known"])
                        places = np.array(sorted(table), np.uint32)
                        ok = np.isin(who, places)
                        keys, who = keys[ok], who[ok]
                        label = np.array([table[x] for x in places.tolist()], np.int64)[np.searchsorted(places, who)]
                    at = B.split(((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64), n)
                    for i in np.flatnonzero(np.diff(at)).tolist():
                        s = slice(at[i], at[i + 1])
                        yield i, r["block_id"], C.pack_sorted(keys[s] >> spare), C.pack(who[s], 1), None if label is None else C.pack(label[s], 1)

        yield from C.emit(items(), _POSTED)

    return run


def _groups(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Keys, refs and labels of one bucket in order of (key, ref), of keys that several rows share; the
    first place and the size of each group."""
    keys, refs, labels = [], [], []
    for i in range(table.num_rows):
        keys.append(C.unpack_sorted(table.column("keys")[i].as_py()))
        refs.append(_refs(table.column("block_id")[i].as_py(), C.unpack(table.column("members")[i].as_py(), np.uint32)))
        blob = table.column("labels")[i].as_py()
        labels.append(refs[-1] if blob is None else C.unpack(blob, np.int64))
    k, r, x = np.concatenate(keys), np.concatenate(refs), np.concatenate(labels)
    del keys, refs, labels
    order = np.argsort(k)
    k, r, x = k[order], r[order], x[order]
    same = k[1:] == k[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    k, r, x = k[shared], r[shared], x[shared]
    order = np.lexsort((r, k))
    k, r, x = k[order], r[order], x[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k, r, x, first, np.diff(first, append=len(k))


_MET = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _meet(table: pa.Table) -> pa.Table:
    """Pairs of one bucket: (first member of a local cluster, member), kind 0, and neighbours, kind 1."""
    k, r, _, first, size = _groups(table)
    if not len(k):
        return _MET.empty_table()
    members, at = C.distinct(r)
    by_member = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.diff(at[by_member], prepend=-1))
    label = np.arange(len(members))
    while True:
        low = np.minimum.reduceat(np.repeat(np.minimum.reduceat(label[at], first), size)[by_member], starts)
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    star = np.stack([members[label], members], 1)
    inner = np.ones(len(r), bool)
    inner[first] = False
    i = np.flatnonzero(inner)
    near = np.stack([r[i - 1], r[i]], 1)
    star, near = (np.unique(p[p[:, 0] != p[:, 1]], axis=0) for p in (star, near))
    return pa.Table.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int32), [len(star), len(near)])), *(pa.array(np.concatenate([star[:, c], near[:, c]])) for c in (0, 1))], schema=_MET)


_OPEN = pa.schema([("g", pa.int64()), ("m", pa.int64()), ("ref", pa.int64()), ("label", pa.int64())])


def _open(table: pa.Table) -> pa.Table:
    """Members of groups with several labels, groups of the same members once."""
    k, r, x, first, size = _groups(table)
    if not len(k):
        return _OPEN.empty_table()
    mixed = np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first)
    g = C.mix64(np.add.reduceat(C.mix64(r.view(np.uint64) + _SALT), first) ^ (size.astype(np.uint64) * _SALT)).view(np.int64)
    _, once = np.unique(g[mixed], return_index=True)
    kept = np.zeros(len(first), bool)
    kept[np.flatnonzero(mixed)[once]] = True
    rows = np.repeat(kept, size)
    return pa.Table.from_arrays([pa.array(np.repeat(g, size)[rows]), pa.array(np.repeat(size, size)[rows]), pa.array(r[rows]), pa.array(x[rows])], schema=_OPEN)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _cross(table: pa.Table) -> pa.Table:
    """Pairs across labels of one square of a group that the bounds allow."""
    i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
    node, c, n, x = (table.column(y).to_numpy() for y in ("node", "c", "n", "label"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
    left, right = np.flatnonzero(c == i), np.flatnonzero(c == j)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for p in left.tolist():
        near = right[x[right] != x[p]]
        near = near[(5 * np.minimum(n[near], n[p]) >= 4 * np.maximum(n[near], n[p]))]
        near = near[9 * np.bitwise_count(sketch[near] ^ sketch[p]).sum(1, dtype=np.int64) <= n[near] + n[p]]
        a.append(np.full(len(near), node[p]))
        b.append(node[near])
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_PAIR)


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes, and whose parity sketches' Hamming distance, allow a link."""
    for x in batches:
        if x.num_rows:
            na, nb = (x.column(c).to_numpy() for c in ("n_a", "n_b"))
            sa, sb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint64).reshape(x.num_rows, -1) for c in ("s_a", "s_b"))
            far = np.bitwise_count(sa ^ sb).sum(1, dtype=np.int64)
            ok = (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (9 * far <= na + nb)
            yield pa.RecordBatch.from_arrays([x.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])


_TEXT = pa.schema([("node", pa.int64()), ("words", pa.binary())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted places of blocks, compressed."""
    press = zstandard.ZstdCompressor(level=3)

    def items():
        for b in batches:
            for r in b.to_pylist():
                block = B.Block(r)
                words, ends = block.words, np.cumsum(block.lengths)
                for w in r["wanted"]:
                    i = w["ref"] & 0xFFFFFF
                    ids = block.ids[ends[i] - block.lengths[i] : ends[i]].tolist()
                    yield w["node"], press.compress(b" ".join([words[j] for j in ids]))

    yield from C.emit(items(), _TEXT, n=1024, size=4 << 20)


def _verify(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        last: dict[int, np.ndarray] = {}

        def load(node: int, blob: bytes) -> np.ndarray:
            if node not in last:
                if len(last) > 64:
                    last.clear()
                if len(known) > 200_000:
                    known.clear()
                words = zstandard.ZstdDecompressor().decompress(blob).split()
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w)
                last[node] = shingles(np.array([known[w] for w in words], np.uint64), n)
            return last[node]

        for b in batches:
            out = []
            for x, y, tx, ty in C.rows([b], "a", "b", "t_a", "t_b"):
                u, v = load(x, tx), load(y, ty)
                both = len(np.intersect1d(u, v, assume_unique=True))
                out.append(100 * both >= 80 * (len(u) + len(v) - both))
            ok = pa.array(out, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id) of every id in edges (a, b), by alternating large and small
    stars: each round joins every id to the least of its neighbours, and the number of rounds is about
    the logarithm of a component's diameter.  Nothing is gathered by key but minima.  It ends when a round changes no edge."""
    stored = C.checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.lit(1).alias("now")).where("u <> v").distinct())
    while True:
        e = stored.where("now = 1").select("u", "v")
        # large star: the neighbours above u, to the least around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the neighbours below u and u itself, to the least below u
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v")
        # edges of this round (now) and of the one before
        marked = small.select("u", "v", F.lit(1).alias("now"), F.lit(0).alias("was")).unionByName(e.select("u", "v", F.lit(0).alias("now"), F.lit(1).alias("was")))
        after = C.checkpoint(marked.groupBy("u", "v").agg(F.max("now").alias("now"), F.max("was").alias("was")))
        C.forget(stored)
        stored = after
        if after.where("now <> was").isEmpty():
            return after.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def join(docs: DataFrame, n: int = 5, key: str = "doc_id", text: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) of every row."""
    blocks = B.build(docs, tokenize, block_bytes, key, text)
    signed = C.checkpoint(blocks.mapInArrow(C.tidy(_sign(n)), SIGNED))
    total = signed.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    rows = signed.select("block_id", "doc_ids", "sizes", "nodes", "sketches").mapInArrow(C.tidy(_rows), "doc_id long, ref long, node long, n_shingles long, sketch binary")
    # one row for each distinct set
    info = C.checkpoint(rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("id"), F.min("ref").alias("ref"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch")))
    rows = C.checkpoint(rows.drop("sketch"))
    n_buckets = B.buckets(total, 2_000_000)
    nothing = F.lit(None).cast("array<struct<place:int,label:bigint>>").alias("known")
    met = C.checkpoint(signed.select("block_id", "keys", "members", nothing).mapInArrow(C.tidy(_post(n_buckets)), POSTED).groupBy("bucket").applyInArrow(C.tidy(_meet), "kind int, a long, b long"))
    node_of = rows.where("n_shingles > 0").select("ref", "node")
    block_of = F.shiftleft(F.shiftright("ref", 40), 32) + F.shiftright("ref", 24).bitwiseAND(F.lit(0xFFFF))

    def named(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(node_of.select(F.col("ref").alias(c), F.col("node").alias(f"{c}_node")), c).drop(c).withColumnRenamed(f"{c}_node", c)
        return df

    def verified(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs of nodes (a, b), those that are linked."""
        side = lambda c: info.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
        pairs = C.checkpoint(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(C.tidy(_may_link), "a long, b long"))
        needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(info.select("node", "ref"), "node")
        wanted = needed.groupBy(block_of.alias("block_id")).agg(F.collect_list(F.struct("ref", "node")).alias("wanted"))  # at most a block's documents
        words = C.checkpoint(blocks.join(wanted, "block_id").mapInArrow(C.tidy(_texts), "node long, words binary"))
        got = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("t_a")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("t_b")), "b")
        out = C.checkpoint(got.select("a", "b", "t_a", "t_b").mapInArrow(C.tidy(_verify(n)), "a long, b long"))
        C.forget(pairs, words)
        return out

    def labels(links: DataFrame) -> DataFrame:
        """node, label (the least node of the component) of nodes with links."""
        found = components(links).select(F.col("id").alias("node"), F.col("component").alias("label"))
        return C.checkpoint(found.unionByName(found.select(F.col("label").alias("node"), "label").distinct()))

    def labelled(df: DataFrame, label: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(label.select(F.col("node").alias(node), F.col("label").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    met_nodes = named(met.groupBy("a", "b").agg(F.min("kind").alias("kind")), "a", "b").where("a <> b")
    pairs = C.checkpoint(met_nodes.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("kind").alias("kind")))
    C.forget(met)
    links = verified(pairs.where("kind = 0").select("a", "b"))
    first = labels(links)
    across = labelled(labelled(pairs.where("kind = 1"), first, "a", "l_a"), first, "b", "l_b").where("l_a <> l_b").select("a", "b")
    links = links.unionByName(verified(across))
    C.forget(first)
    found = labels(links)
    # the keys of all documents that met another one, with their components
    active = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named_rows = labelled(node_of.join(active, "node", "left_semi"), found, "node", "label")
    known = named_rows.groupBy(block_of.alias("block_id")).agg(F.collect_list(F.struct(F.col("ref").bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("place"), "label")).alias("known"))  # at most a block's documents
    again = signed.select("block_id", "keys", "members").join(known, "block_id").mapInArrow(C.tidy(_post(n_buckets)), POSTED)
    opened = C.checkpoint(again.groupBy("bucket").applyInArrow(C.tidy(_open), "g long, m long, ref long, label long"))
    C.forget(pairs, signed)
    if not opened.isEmpty():
        members = opened.join(node_of, "ref").select("g", "m", "node", "label").distinct().join(info.select("node", "n", "sketch"), "node")
        squares = members.withColumn("k", F.ceil(F.col("m") / CHUNK).cast("int")).withColumn("c", F.pmod(F.hash("node"), F.col("k")))
        squares = squares.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("g", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "node", "n", "label", "sketch")
        links = links.unionByName(verified(squares.groupBy("g", "i", "j").applyInArrow(C.tidy(_cross), "a long, b long").distinct()))
        C.forget(found)
        found = labels(links)
    C.forget(opened, blocks)
    least = found.join(info.select("node", "id"), "node").groupBy("label").agg(F.min("id").alias("component_id"))
    ids = info.select("node", "id").join(found.join(least, "label").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "id").alias("component_id"))
    out = rows.drop("ref").join(ids, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest id stays, of rows with equal ids the one
    that hashes least, of rows with equal ids and texts one; rows without shingles all stay.  Rows are known by
    64 bits of their id and text, so equal ids with different texts aren't mixed up, and rows without an id have their turn last."""
    rows = docs.select(C.whole(docs), C.column(key).alias("id"), F.xxhash64(C.column(key), C.column(text)).alias("k"), C.column(text).alias("text"))
    joined = C.checkpoint(join(rows, n, key="k").where("n_shingles > 0").groupBy(F.col("doc_id").alias("k"), F.col("component_id").alias("c")).agg(F.count("*").alias("times")))
    several = joined.groupBy("c").agg(F.sum("times").alias("size")).where("size > 1")
    mine = joined.join(several, "c").select("k", "c", "times")
    own = rows.select("k", "id").join(mine, "k").select("k", "c", "times", F.struct(F.col("id").isNull(), "id", "k").alias("place")).distinct()
    best = own.groupBy("c").agg(F.min("place").alias("place")).select("c", F.col("place.k").alias("best"))
    out = C.checkpoint(own.join(best, "c").select("k", (F.col("k") == F.col("best")).alias("stays"), "times"))
    kept = rows.join(out.select("k"), "k", "left_anti").unionByName(rows.join(out.where("stays AND times = 1").select("k"), "k", "left_semi"))
    if not out.where("stays AND times > 1").isEmpty():
        kept = kept.unionByName(rows.join(out.where("stays AND times > 1").select("k"), "k", "left_semi").dropDuplicates(["k"]))
    return kept.select("row.*")
