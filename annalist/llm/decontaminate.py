"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions only.

Test texts become windows of ``n`` words, kept in segments of SEGMENT windows that follow each other.  Terms of the
tests are counted over the whole corpus; each window is looked up by its ANCHORS rarest terms.  The index
stores (term, text, position) postings of the anchor terms.  A posting at the offset of an anchor gives
the place where its segment would begin; lists are intersected there, by segment, text and begin: an anchor is a bit,
and a place whose bits hold all anchors of some window is a candidate.  Candidates are then compared word by
word with the text, in pieces of PIECE words: exact phrases.  Proximity matches are places where the anchors of
a window stand within ``slop`` words of their offsets.

The corpus is cut into words three times: to count test terms (partial aggregation, as many keys as the
tests have terms), for the postings of anchor terms, and to count the words of each row; only texts with
candidates are cut once more.  Texts are known by 128 bits of hash, so copies are looked at once, and rows need no
key.  What is measured to be small (BROADCAST_BYTES) is broadcast; beyond that the same joins shuffle, where adaptive execution
splits hot terms and texts.

Defined results: letters A-Z count as lower case; an item of fewer words than n is one window, one
without words (null, empty) none; a null or empty document has no words and no hits; repeated
documents each have a row, repeated items count once; a null item_id is an item without a name: it counts, and isn't
listed; a null doc_id stays null; other columns are ignored by ``scan``, kept by ``marked``.  Either table may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, column, forget, whole

#: Fixed value: what separates words once A-Z are in lower case (all ASCII but letters and digits).
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANCHORS = 3
SEGMENT = 64 // ANCHORS  # windows, so that a segment's anchors fit the bits of a long
PIECE = 4096  # words
BROADCAST_BYTES = 32 << 20
TEXT = ["h1", "h2"]


def words(text: str | Column) -> Column:
    """Words with letters A-Z in lower case."""
    text = F.coalesce((column(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATOR), "")


def windows(items: DataFrame, n: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, w: the words of each segment, a run of SEGMENT windows, of every item."""
    w = items.select(column(key).cast("string").alias("item"), words(text).alias("w")).where("size(w) > 0")
    at = w.select("item", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {n}, 0), {SEGMENT})")).alias("i"))
    return at.select("item", F.expr(f"slice(w, i + 1, {SEGMENT + n - 1})").alias("w")).distinct()


def few(df: DataFrame) -> DataFrame:
    """A checkpoint, broadcast if its rows, written out, are small."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


class Index:
    """Positional postings of a corpus for the tests to come (see ``windows``; of the same n)."""

    def __init__(self, docs: DataFrame, tests: DataFrame, n: int = 10, text: str = "text"):
        self.n = n
        t = F.coalesce(column(text).cast("string"), F.lit(""))
        self.docs = docs.select(whole(docs), t.alias("t")).select("row", "t", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(7), "t").alias("h2"))
        # segments by number: their words needn't travel
        numbered = checkpoint(tests.select("w").distinct().withColumn("seg", F.monotonically_increasing_id()))
        self.items = checkpoint(tests.join(numbered, "w").select("seg", "item"))
        each = numbered.select("seg", F.posexplode("w").alias("q", "term"))
        terms = checkpoint(each.select("term").distinct())
        counts = checkpoint(self.docs.select(F.explode(words("t")).alias("term")).join(few(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("cf")))
        # the words of a segment in order, with their counts: SEGMENT + n - 1 of them at most
        counted = each.join(counts, "term", "left").groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("q", "cf", "term"))).alias("x"))
        run = f"slice(x, i + 1, {n})"
        starts = f"filter(sequence(0, greatest(size(x) - {n}, 0)), i -> NOT exists({run}, y -> y.cf IS NULL))"  # a window with a term that the corpus lacks occurs nowhere
        rarest = f"transform(slice(array_sort(transform({run}, y -> struct(y.cf, y.term, y.q))), 1, {ANCHORS}), y -> y.q)"
        tops = counted.select("seg", "x", F.expr(f"transform({starts}, i -> struct(i, {rarest} AS anchors))").alias("tops"))
        tops = tops.withColumn("used", F.expr("array_sort(array_distinct(flatten(tops.anchors)))"))
        mask = "aggregate(t.anchors, 0L, (m, q) -> m | shiftleft(1L, array_position(used, q)::int - 1))"
        tops = tops.withColumn("masks", F.expr(f"transform(tops, t -> {mask})")).join(numbered, "seg").where("size(used) > 0")
        self.segments = checkpoint(tops.select("seg", "w", "x", "tops", "used", "masks"))
        self.small = few(self.segments.select("seg", "w", "masks"))
        anchors = self.segments.select("seg", "x", F.posexplode("used").alias("k", "q")).select("seg", "q", F.expr("x[q].term").alias("term"), F.expr("shiftleft(1L, k)").alias("bit"))
        self.anchors = checkpoint(anchors)
        wanted = checkpoint(anchors.select("term").distinct())
        places = self.docs.select(*TEXT, F.posexplode(words("t")).alias("pos", "term"))
        self.postings = checkpoint(places.join(few(wanted), "term", "left_semi").select("term", *TEXT, "pos"))
        forget(terms, counts, wanted, numbered)

    def candidates(self) -> DataFrame:
        """seg, text, begin (of the segment in the text; negative before its start) where all anchors of a window meet."""
        hits = self.postings.join(few(self.anchors), "term").select("seg", *TEXT, (F.col("pos") - F.col("q")).alias("begin"), "bit")
        met = hits.groupBy("seg", *TEXT, "begin").agg(F.bit_or("bit").alias("bits"))
        return met.join(self.small, "seg").where("exists(masks, m -> (bits & m) = m)").select("seg", *TEXT, "begin", "w")

    def phrases(self) -> DataFrame:
        """seg, text, start, size of the windows that occur."""
        found = checkpoint(self.candidates().withColumn("piece", F.expr(f"cast(floor(greatest(begin, 0) / {PIECE}) AS int)")))
        asked = found.groupBy(*TEXT, "piece").agg(F.collect_list(F.struct("seg", "begin", "w")).alias("c"))  # PIECE places of each segment at most
        texts = checkpoint(found.select(*TEXT).distinct())
        own = self.docs.select(*TEXT, "t").join(few(texts), TEXT, "left_semi").dropDuplicates(TEXT).select(*TEXT, words("t").alias("v"))
        reach = PIECE + SEGMENT + self.n - 1
        pieces = own.select(*TEXT, "v", F.explode(F.expr(f"sequence(0, cast((greatest(size(v), 1) - 1) / {PIECE} AS int))")).alias("piece")).withColumn("v", F.expr(f"slice(v, piece * {PIECE} + 1, {reach})"))
        both = pieces.join(asked, [*TEXT, "piece"])
        size = f"least({self.n}, size(x.w))"
        at = f"(x.begin - piece * {PIECE} + i)"
        same = f"CASE WHEN {at} >= 0 THEN slice(v, greatest({at}, 0) + 1, {size}) = slice(x.w, i + 1, {size}) ELSE false END"
        starts = f"transform(filter(sequence(0, size(x.w) - {size}), i -> {same}), i -> struct(x.seg AS seg, x.begin + i AS start, {size} AS size))"
        hits = both.select(*TEXT, F.expr(f"flatten(transform(c, x -> {starts}))").alias("hits"))  # the words stay behind
        out = checkpoint(hits.select(*TEXT, F.explode("hits").alias("x")).select("x.seg", *TEXT, "x.start", "x.size").distinct())
        forget(found, texts)
        return out

    def by_text(self) -> DataFrame:
        """text, n_hit, n_items, items of texts with some window."""
        found = self.phrases()
        hit = found.select(*TEXT, F.explode(F.expr("sequence(start, start + size - 1)")).alias("p")).distinct().groupBy(*TEXT).agg(F.count("*").alias("n_hit"))
        who = found.select(*TEXT, "seg").distinct().join(few(self.items), "seg").select(*TEXT, "item").distinct()
        named = who.groupBy(*TEXT).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set("item")).alias("items"))
        out = checkpoint(hit.join(named, TEXT))
        forget(found)
        return out

    def marked(self) -> DataFrame:
        """row (the columns of docs), n_words, n_hit, n_items, items of every row of docs."""
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        rows = self.docs.select("row", *TEXT, F.size(words("t")).cast("long").alias("n_words"))
        found = few(self.by_text())
        return rows.join(found, TEXT, "left").select("row", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))

    def clean(self) -> DataFrame:
        """row of every row of docs without any window."""
        found = few(checkpoint(self.phrases().select(*TEXT).distinct()))
        return self.docs.join(found, TEXT, "left_anti").select("row")

    def near(self, slop: int = 5) -> DataFrame:
        """row, item, start of proximity matches: each anchor of a window stands within slop words of where it would be
        if the window began at start, a place given by the rarest."""
        tops = self.segments.select("seg", "x", F.explode("tops").alias("t")).select("seg", "x", F.col("t.i").alias("i"), F.posexplode("t.anchors").alias("rank", "q"))
        tops = tops.select("seg", "i", "rank", F.expr("q - i").alias("offset"), F.expr("x[q].term").alias("term"))
        place = ["seg", "i", *TEXT]
        at = lambda r: self.postings.join(tops.where(F.col("rank") == r), "term").select(*place, (F.col("pos") - F.col("offset")).alias("start"))
        found, span = at(0).where("start >= 0").distinct(), slop + 1
        last = tops.groupBy("seg", "i").agg(F.max("rank").alias("last"))
        for rank in range(1, ANCHORS):
            # places fall in cells of span words, so a match lies in the same cell or one beside it
            more = at(rank).select(*place, F.col("start").alias("s2"), F.explode(F.array(*(F.floor(F.col("start") / span) + d for d in (-1, 0, 1)))).alias("cell"))
            close = found.withColumn("cell", F.floor(F.col("start") / span)).join(more, [*place, "cell"]).where(F.abs(F.col("start") - F.col("s2")) <= slop).select(*place, "start").distinct()
            found = close.unionByName(found.join(last.where(F.col("last") < rank), ["seg", "i"], "left_semi"))
        return self.docs.select("row", *TEXT).join(found.join(self.items, "seg").select(*TEXT, "item", "start").distinct(), TEXT).select("row", "item", "start")


def scan(docs: DataFrame, items: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items (sorted), contaminated."""
    base = docs.select(column(key).alias("doc_id"), column(text).alias("text"))
    rows = Index(base, windows(items, n, item_key, item_text), n).marked()
    return rows.select("row.doc_id", "n_words", "n_hit", "n_items", "items", (F.col("n_hit") > 0).alias("contaminated"))


def digests(scanned: DataFrame) -> DataFrame:
    return scanned.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), tests AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 9), ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM tests WHERE len(w) > 0)
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM split
), grams AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM places, (SELECT DISTINCT n FROM windows) WHERE i + n - 1 <= len(w)
), hits AS (
  SELECT doc_id, i, n, item FROM grams JOIN windows USING (win, n)
), hit_words AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, range(0, 10) AS r(j) WHERE j < n GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
