"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once and stores, for each document, the measurements and one bit for
each failed rule.  Policies are versioned sets of rules (masks): ``apply_policy`` and ``ablations`` work
on the stored bits alone, so a new policy or an ablation never reads a text again.

All work is row by row but for the ablations, which are one bitwise aggregation of bounded size; no row
is shuffled and a hot source costs nothing extra.  Repeated five-word windows are found by sorting 64-bit
hashes of the windows of one text, only in texts where the hashes are not distinct, and compared word by word.

Defined results: a null text has no words and fails the rules that ask for words; repeated rows are
measured row by row; a null id stays null; an empty table gives an empty ledger; other columns are ignored by ``ledger``
and kept apart by ``measured``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, whole

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: name -> the bit it sets and when.  Bits are never reused: a ledger outlives its policies.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 10"),
    "repeated_windows": (1, "100 * n_repeat_words > 20 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "repeated_lines": (3, "2 * n_dup_lines > n_lines"),
    "stuttering": (4, "4 * n_stutter > n_words"),
    "long_words": (5, "word_chars > 20 * n_words"),
    "short_words": (6, "word_chars < 2 * n_words"),
}


def mask(*rules: str) -> int:
    return sum(1 << RULES[r][0] for r in rules)


#: version -> mask of the rules that reject a document.
POLICIES: dict[str, int] = {
    "base": mask("few_words", "repeated_windows"),
    "2024.1": mask("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "2024.2": mask(*RULES),
}
CURRENT = "2024.2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stutter", "n_repeat_words", "bits")


def _words(text: str) -> Column:
    trimmed = F.trim(F.col(text), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and ``bits`` (the failed rules) of every row."""
    rows = measured(docs.select(column(key).alias("doc_id"), column(text).alias("text")))
    return rows.select(F.col("row.doc_id").alias("doc_id"), *MEASURES)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (all columns of docs, whatever their names), the measurements and ``bits``."""
    d = docs.select(whole(docs), F.coalesce(column(text).cast("string"), F.lit("")).alias("t"))
    d = d.select("row", "t", _words("t").alias("w"), F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("l"))
    size = F.size("w")
    hashes = F.expr(f"CASE WHEN size(w) > {WINDOW} THEN transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(WINDOW))})) ELSE array() END")
    d = d.select(
        "row",
        size.cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr("size(filter(w, (x, i) -> i > 0 AND x = w[greatest(i - 1, 0)]))").cast("long").alias("n_stutter"),
        "w",
        hashes.alias("h"),
    )
    # (hash, place) in order of hashes, of texts with some repeated window only; equal hashes count when the words are equal
    d = d.withColumn("p", F.expr("CASE WHEN size(array_distinct(h)) = size(h) THEN array() ELSE array_sort(transform(h, (h, i) -> struct(h, i))) END")).drop("h")
    same = lambda j, k: f"(p[{j}].h = p[{k}].h AND slice(w, p[{j}].i + 1, {WINDOW}) = slice(w, p[{k}].i + 1, {WINDOW}))"
    d = d.withColumn("i", F.expr(f"array_sort(transform(filter(p, (x, j) -> (j > 0 AND {same('greatest(j - 1, 0)', 'j')}) OR (j < size(p) - 1 AND {same('j', 'least(j + 1, size(p) - 1)')})), x -> x.i))"))
    covered = F.expr(f"aggregate(i, struct({-WINDOW} AS last, 0L AS n), (s, i) -> struct(i AS last, s.n + least({WINDOW}, i - s.last) AS n), s -> s.n)")
    d = d.withColumn("n_repeat_words", covered).drop("p", "i", "w")
    bits = sum((F.when(F.expr(rule), F.lit(1 << bit)).otherwise(0).cast("long") for bit, rule in RULES.values()), F.lit(0).cast("long"))
    return d.withColumn("bits", bits)


def store(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ledger of docs to path; what later policies and ablations read instead of texts."""
    ledger(docs, key, text).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    hit = lambda m: F.col("bits").bitwiseAND(F.lit(m).cast("long")) != 0
    return rows.withColumn("base_failed", hit(POLICIES["base"])).withColumn("kept", ~hit(POLICIES[version] | POLICIES["base"]))


def ablations(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """For each policy and rule of it: documents that fail the rule, that fail it alone (which would
    be kept without it), and how many the policy keeps; with the bits failed anywhere and everywhere."""
    policies = POLICIES if policies is None else policies
    hit = lambda m: F.col("bits").bitwiseAND(F.lit(m).cast("long"))
    aggs = [F.count("*").alias("n_docs"), F.bit_or("bits").alias("any_bits"), F.bit_and("bits").alias("all_bits")]
    for v, m in policies.items():
        aggs.append(F.count_if(hit(m) == 0).alias(f"kept|{v}"))
        for r, (bit, _) in RULES.items():
            if m >> bit & 1:
                aggs += [F.count_if(hit(1 << bit) != 0).alias(f"failed|{v}|{r}"), F.count_if(hit(m) == 1 << bit).alias(f"alone|{v}|{r}")]
    one = rows.agg(*aggs)
    cell = lambda n: F.col(f"`{n}`")
    each = [F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), cell(f"kept|{v}").alias("kept"), cell(f"failed|{v}|{r}").alias("failed"), cell(f"alone|{v}|{r}").alias("failed_alone")) for v, m in policies.items() for r, (bit, _) in RULES.items() if m >> bit & 1]
    return one.select("n_docs", "any_bits", "all_bits", F.inline(F.array(*each)))


def with_ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """rows with ``alone_bit<b>``: how many rows of the whole ledger the policy's rule of bit b rejects and no other rule of it."""
    m = POLICIES[version]
    failed = F.col("bits").bitwiseAND(F.lit(m).cast("long"))
    names = {f"alone_bit{bit}": bit for bit, _ in RULES.values() if m >> bit & 1}
    one = rows.agg(*(F.count_if(failed == 1 << bit).alias(name) for name, bit in names.items())).first()  # a number a rule
    return rows.withColumns({name: F.lit(one[name]).cast("long") for name in names})


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 4)) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM windows, range(0, 5) AS r(j) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutter,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN repeated USING (doc_id)
)
SELECT *, CAST(count_if(bits = 1) OVER () AS BIGINT) AS alone_bit0, CAST(count_if(bits = 2) OVER () AS BIGINT) AS alone_bit1, CAST(count_if(bits = 4) OVER () AS BIGINT) AS alone_bit2,
       CAST(count_if(bits = 8) OVER () AS BIGINT) AS alone_bit3, CAST(count_if(bits = 16) OVER () AS BIGINT) AS alone_bit4, CAST(count_if(bits = 32) OVER () AS BIGINT) AS alone_bit5,
       CAST(count_if(bits = 64) OVER () AS BIGINT) AS alone_bit6 FROM (
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
            + 16 * (4 * n_stutter > n_words)::INT + 32 * (word_chars > 20 * n_words)::INT + 64 * (word_chars < 2 * n_words)::INT AS BIGINT) AS bits,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR 4 * n_stutter > n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept
FROM m)
"""
