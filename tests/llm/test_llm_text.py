"""LM scoring, BPE, HTML, quality, decontamination, licenses, token counts and the id store, by brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist.llm import blocks, bpe, decontaminate, html_extract, id_store, licenses, lm_scoring, quality, token_counts
from annalist.llm import common as C

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    (0, "The cat sat on the mat. The cat sat."),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "the dog  sat on\nthe mat"),
    (5, "the dog  sat on\nthe mat"),
    (6, "Ünïcode 漢字   x" * 50),
    (7, "the cat " * 3000),
    (8, "a"),
    (9, "on the mat the cat sat on the mat"),
    (10, "İI ẞ Σς"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long, n_tokens string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_codecs(xs):
    a = np.array(sorted(xs), np.uint64)
    assert (C.unpack_sorted(C.pack_sorted(a)) == a).all()
    assert (C.unpack(C.pack(a), np.uint64) == a).all()
    words = [str(x).encode() for x in xs]
    assert C.unpack_words(*C.pack_words(words)) == words


def test_lm_scores(docs, empty):
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, block_bytes=200).collect()}
    words = {i: (t or "").encode().lower().split() for i, t in TEXTS}
    train = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in [*ws, None])
    n, v = sum(train.values()), len(train)
    assert len(got) == len(TEXTS)
    for i, ws in words.items():
        tokens = [*ws, None]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] < 0
    assert lm_scoring.score(empty).count() == 0


def test_lm_is_a_distribution(spark):
    """Probabilities of all next tokens after a context add up to one (with one unknown word)."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a b a", "b a"] * 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    probes = ["", "a", "b", "c", "zzz"]
    keep = [i for i in range(10_000, 11_000) if zlib.crc32(str(i).encode()) % 10 == 0][: len(probes)]  # the excluded fold
    base = spark.createDataFrame([(i, p) for i, p in zip(keep, probes, strict=True)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(d.unionByName(base), order=3).collect()}
    p = [10 ** got[i] for i in keep]
    # one-word texts are (word, end): each is at most the probability of its first word
    assert 0 < sum(p) <= 1 + 1e-9


def test_bpe(docs, empty):
    enc = bpe._encoding(RANKS, P.PATTERN)
    got = {r["doc_id"]: r for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    for i, t in TEXTS:
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    e = bpe.encode(docs, RANKS, P.PATTERN)
    back = {r["doc_id"]: bytes(r["raw"]).decode() for r in bpe.decode(e, RANKS).collect()}
    assert back == {i: t or "" for i, t in TEXTS}
    assert bpe.digests(empty, RANKS, P.PATTERN).count() == 0


def test_blocks_round_trip(docs):
    rows = [blocks.Block(r.asDict()) for r in blocks.build(docs, lm_scoring.tokenize, 100).collect()]
    got = {}
    for b in rows:
        at = 0
        for i, n in zip(b.doc_ids.tolist(), b.lengths.tolist(), strict=True):
            got[i] = [b.words[j] for j in b.ids[at : at + n]]
            at += n
    assert got == {i: (t or "").encode().lower().split() for i, t in TEXTS}


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><header>Site</header><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b> &copy text<br>next<p>second<!-- no --> line<div class="share">tweet</div></p>
<pre>a
 b</pre><form><input>Sign up</form></article><aside>Related</aside><section id="comments"><p>Great post!</p></section><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "Title & more\nFirst bold © text\nnext\nsecond line\na b"
    assert html_extract.extract(PAGE) == want
    assert html_extract.extract("") == "" and html_extract.extract("<") is not None
    bare = "<div class=nav><a>x</a> <a>y</a></div><div>" + "<p>" + "word " * 40 + "</p>" * 3 + "<p>more text here</p></div><div class='footer'>foot</div>"
    assert html_extract.extract(bare) == ("word " * 40).strip() + "\nmore text here"
    p = spark.createDataFrame([(1, "u", PAGE, "c"), (2, None, None, "c")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract_pages(p).collect()}
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want) and got[2]["text"] == "" and got[2]["n_chars"] == 0
    assert html_extract.extract_pages(p.where("false")).count() == 0
    assert html_extract.extract("<p>" + "<b>" * 20_000 + "x" * 100 + "</p>") == "x" * 100


def brute_quality(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))


def test_quality(spark, docs, empty):
    more = [(20, "a b c d e\nx # y | z\na b c d e\nx # y | z\n" * 3), (21, "pp qq rr ss tt uu vv ww xx yy"), (22, "of of the the of of the the a a b b")]
    d = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = quality.ledger(d)
    got = {r["doc_id"]: r for r in quality.apply_policy(rows).collect()}
    for i, t in [*TEXTS, *more]:
        r = got[i]
        n, chars, symbols, dup, rep = want = brute_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (r["base_failed"] and r["kept"])
    assert got[21]["kept"] and not got[22]["kept"]
    a = {(r["policy"], r["rule"]): r for r in quality.ablations(rows).collect()}
    assert a["base", "few_words"]["failed"] == sum(brute_quality(t)[0] < 10 for _, t in [*TEXTS, *more])
    assert quality.apply_policy(quality.ledger(empty)).count() == 0
    clash = spark.createDataFrame([(1, "a b", "x", "y", 7, None)], "doc_id long, text string, w string, row string, bits long, n_words string")
    assert [tuple(r) for r in quality.measured(clash).where("n_words = 2").select("row.*").collect()] == [(1, "a b", "x", "y", 7, None)]
    assert [r["doc_id"] for r in quality.ledger(clash.withColumn("doc_id", F.lit(None).cast("long"))).collect()] == [None]


def test_stored_ledger(spark, docs, tmp_path):
    """Policies and ablations read the stored bits alone."""
    more = spark.createDataFrame([(50, "# $ " * 40), (51, "# * " * 9), (52, "one two three four five six seven eight nine ten eleven")], "doc_id long, text string")
    rows = quality.store(docs.unionByName(more, allowMissingColumns=True), str(tmp_path / "ledger"))
    assert "text" not in rows.columns
    got = quality.with_ablations(quality.apply_policy(rows), quality.CURRENT).collect()
    for name, (bit, _) in quality.RULES.items():
        assert {r[f"alone_bit{bit}"] for r in got} == {sum(r["bits"] == 1 << bit for r in got)}, name
    by_rule = {r["rule"]: r["failed_alone"] for r in quality.ablations(rows).where(f"policy = '{quality.CURRENT}'").collect()}
    assert by_rule == {name: got[0][f"alone_bit{bit}"] for name, (bit, _) in quality.RULES.items()}


def brute_hits(docs, items, n=10):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - n, 0) + 1) if w else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for win, who in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= who
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, docs, empty):
    ten = "one two three four five six seven eight nine ten"
    more = [(30, f"x {ten.upper()}, eleven. {ten}"), (31, ten.replace("five", "5")), (32, "short item"), (33, "É é short item É"), (34, "na " * 40)]
    items = [(1, ten + " eleven"), (2, "Short; item!"), (3, None), (4, "..."), (10, ten), (5, "na " * 12), (5, "na " * 12)]
    d = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.digests(decontaminate.scan(d, b)).collect()}
    assert got == brute_hits([*TEXTS, *more], items)
    assert decontaminate.scan(empty, b).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.scan(docs, b.where("false")).collect())


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "x " * 30 + "beta gamma")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    ix = decontaminate.Index(d, decontaminate.windows(b))
    assert {r["row"]["doc_id"] for r in ix.near(slop=3).collect()} == {1} and ix.marked().where("n_hit > 0").count() == 0


def test_html_without_head_end():
    head = "<!doctype html><html><head><meta charset=utf-8><title>t</title><script>x</script><link rel=a>\n"
    main = "<p>" + ("word " * 40).strip() + "</p><p>more text here"
    want = ("word " * 40).strip() + "\nmore text here"
    for start in ("<body>", "<BODY class=a>", "", "</head><body>", "</head>"):
        assert html_extract.extract(head + start + main) == want
    assert html_extract.extract(head + "Bare" + main) == "Bare\n" + want
    assert html_extract.extract(head + "<body><nav>Home</nav>" + main + "<footer>me</footer>") == want


def test_licenses(spark, docs, empty):
    t = "Ünder this. Released under the MIT License. And: LICENSED under the Apache licence, Version 2.0! done"
    d = spark.createDataFrame([(1, t), (2, "under the sun"), (3, None), (4, t)], "doc_id long, text string")
    got = {}
    for r in licenses.scan(d).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], t[r["start_char"] : r["end_char"]], round(r["coverage"], 3)))
    assert got == {i: [("MIT", "Released under the MIT License", 1.0), ("Apache-2.0", "LICENSED under the Apache licence, Version 2.0", 0.875)] for i in (1, 4)}
    per = {r["doc_id"]: r["n_licenses"] for r in licenses.per_document(d).collect()}
    assert per == {1: 2, 2: 0, 3: 0, 4: 2} and licenses.scan(empty).count() == 0
    assert licenses.scan(docs).count() == 0
    for name, text in licenses.TEMPLATES.items():
        assert name in {x[0] for x in licenses._scan(licenses.Index({name: text}), 0.8, f"so: {text} end".encode(), {})}


def test_repeated_licenses(spark):
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        for gap in range(14):
            for times in (2, 3, 7):
                t = ("so: " + ("\n" + "x " * gap).join([text] * times) + " end").encode()
                got = [(x[0], x[1], x[3], x[4]) for x in licenses._scan(index, 0.8, t, {})]
                step = len(text) + 1 + 2 * gap
                size = len(text.rstrip(".:"))
                assert got == [(name, 1.0, 4 + i * step, 4 + i * step + size) for i in range(times)], (name, gap, times)
    d = spark.createDataFrame([(1, "Released under the MIT License.\nReleased under the MIT License.\nReleased by the MIT License.\n" * 2)], "doc_id long, text string")
    assert [(r["coverage"], r["start_char"]) for r in licenses.scan(d).orderBy("start_char").collect()] == [(c, 93 * k + x) for k in range(2) for c, x in ((1.0, 0), (1.0, 32), (0.8, 64))]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, empty, rule):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = bpe._encoding(path, P.PATTERN)
    rows = token_counts.by_section(docs, path, P.PATTERN, rule).collect()
    for i, t in TEXTS:
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in mine) == pytest.approx(len(enc.encode_ordinary(t or "")))
        assert "".join((t or "")[r["start_char"] : r["end_char"]] for r in mine) == (t or "")
    assert token_counts.by_section(empty, path, P.PATTERN, rule).count() == 0


def test_attribution_rules():
    ends, starts = np.array([4, 10]), np.array([0, 3, 9])  # tokens 0-4 and 4-10; sections 0-3, 3-9, 9-12
    f = lambda rule: token_counts.attribute(ends, starts, 12, rule)[0].tolist()
    assert f("first") == [1, 1, 0] and f("last") == [0, 1, 1] and f("majority") == [1, 1, 0]
    assert f("split") == pytest.approx([3 / 4, 1 / 4 + 5 / 6, 1 / 6])


def test_fields(spark):
    d = spark.createDataFrame([(1, "hello there", None, "bye")], "doc_id long, a string, b string, c string")
    rows = token_counts.by_field(d, ["a", "b", "c"], P.path("byte_bpe_50k.tiktoken"), P.PATTERN).orderBy("section").collect()
    assert [r["section"] for r in rows] == [0, 1, 2] and sum(r["n_tokens"] for r in rows) == rows[0]["doc_tokens"]


def test_id_store(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [*TEXTS, (11, "say <|endoftext|> and é it's fine"), (4, "another with the same id"), (None, "a row without an id"), (None, None)]
    d = docs.unionByName(spark.createDataFrame(texts[-4:], "doc_id long, text string"), allowMissingColumns=True)
    out = str(tmp_path / "store")
    id_store.write(d, path, out)
    store = id_store.Store(spark, out)
    got = store.digests().orderBy("start").collect()
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    assert [r["doc_id"] for r in got] == [None, None, *sorted(i for i, _ in texts if i is not None)]
    at = 0
    for r in got:
        assert r["start"] == at
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want[r["doc_id"]]]
        at += r["n_tokens"]
    assert sorted(store.read_document(4)) == sorted(want[4]) and store.read_document(999) == []
    assert sum(len(r["ids"]) for r in store.documents().collect()) == at
    assert store.read_document(0) == want[0]
    none = str(tmp_path / "none")
    id_store.write(empty, path, none)
    assert id_store.Store(spark, none).digests().count() == 0


_ODD = st.text(alphabet=st.sampled_from(list("aB z9,.'s-_<|>\n\t\u00e9\u00c9\u0301\u0130\u03a3\u03c3\u00df\u1e9e\u00a0\u2003\u0085\x1c\u6f22\u00b2\u017f\ufb01\u212b")), max_size=40)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    from tokenizers import Tokenizer

    path = P.path(name)
    tok, encoder = Tokenizer.from_file(path), id_store.Encoder(path, 4, 7)
    assert id_store._by_words(path) == name.startswith("word")

    @settings(max_examples=400, deadline=None)
    @given(st.lists(_ODD, max_size=4))
    def same(texts):
        texts = [*texts, "<|ENDOFTEXT|> x<|endoftext|>y it'S DON'T naïve, Größe! 12,5%"]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder(pa.array([t.encode() for t in texts]))]
        assert got == [[*tok.encode(t, add_special_tokens=False).ids, 7] for t in texts]

    same()


def test_id_store_forgets(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    monkeypatch.setattr(id_store, "CACHE", 5)
    monkeypatch.setattr(id_store, "CHUNKS", 5)
    encoder, tok = id_store.Encoder(path, 2, 1), Tokenizer.from_file(path)
    for k in range(12):
        t = " ".join(f"w{'xyz'[j % 3] * (j % 7)} {j}," for j in range(k, k + 9))
        assert np.frombuffer(encoder(pa.array([t]))[0], "<u2").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]


def test_decontamination_of_odd_tables(spark):
    """Against brute force: texts and items longer than a piece and a segment, small vocabularies, rows without ids,
    equal ids with different texts, repeated items, clashing columns."""
    import random

    rng = random.Random(3)
    text = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(1, text(70, 10**6)), (2, text(12, 3)), (3, text(25, 40)), (4, "w1 w1"), (5, "w1"), (None, "only here and there")]
    long = items[0][1].split()
    texts = [text(200, 3), text(300, 40), " ".join(long), " ".join(long[5:40]), text(9000, 10**6), "x " * 4090 + " ".join(long) + " y" * 5000, "w1 w1 only Here and THERE", "", None]
    texts += [f"{texts[4]} {' '.join(long[30:45])} {text(10, 50)} {items[2][1]}"]
    rows = list(enumerate(texts)) + [(0, texts[3]), (None, texts[2]), (None, None), (2, texts[2])]
    d = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, row string, h1 string, n_words string").repartition(4)
    b = spark.createDataFrame([(i, t, "x") for i, t in items + items[:2]], "item_id long, text string, w string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.digests(decontaminate.scan(d, b)).collect())
    want = []
    for i, t in rows:
        (n, hit, found, _, bad), = brute_hits([(0, t)], items).values()
        names = sorted({str(k) for k, x in items if brute_hits([(0, t)], [(k, x)])[0][4] and k is not None})
        want.append((str(i), n, hit, found, hashlib.sha256(",".join(names).encode()).hexdigest(), bad))
    assert got == sorted(want)
    kept = decontaminate.Index(d, decontaminate.windows(b)).marked().where("n_hit = 0").select("row.*")
    assert kept.columns == d.columns and kept.count() == sum(not w[-1] for w in want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x260), st.sampled_from(list(" '\n\tsdmltrev1\u00b2\u00e9\x1c\x85"))), max_size=30))
def test_narrow_pattern_is_the_pattern(text):
    assert bpe.narrow(P.PATTERN) and bpe.narrow(r"\w+") is None and bpe.narrow(r"(?i)a") is None
    got = bpe.splitter(P.PATTERN)(text.encode("utf-8", "replace"))
    t = text.encode("utf-8", "replace").decode()
    assert got == bpe.regex.findall(P.PATTERN, t)
    assert [i for w in got for i in bpe._pieces(RANKS).encode_ordinary(w)] == bpe._encoding(RANKS, P.PATTERN).encode_ordinary(t)


def test_html_distribution_decides():
    """The surge and dive points against sums by brute force, and pages that change with the window and the threshold."""
    import random

    rng = random.Random(5)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 3, 20, 90, 200]) for _ in range(rng.randrange(12))]
        window, threshold, foot = rng.choice([1, 2, 3]), rng.choice([0, 50, 150]), rng.random() < 0.5
        total = [sum(lengths[i : i + window]) for i in range(len(lengths))]
        runs = [i for i in range(len(lengths)) if total[i] and (not i or not total[i - 1])]  # between dives
        want = [False] * len(lengths)
        for a in runs:
            z = next((i for i in range(a, len(lengths)) if not total[i]), len(lengths))
            surges = [i for i in range(a, z) if total[i] > threshold and lengths[i]]
            if surges:
                first = a if foot else surges[0]
                want[first:z] = [True] * (z - first)
        assert html_extract.between(lengths, window, threshold, foot) == want, (lengths, window, threshold, foot)
    prose, short = "word " * 40, "tweet"
    for name in ('class="legal"', 'class="popular"', 'id="related-work"'):
        for mark in ("<article><h1>T</h1>{}</article>", "<div>{}</div>"):
            kept = html_extract.extract(mark.format(f"<p>{prose}</p><section {name}><p>{prose}</p></section><p>{prose}</p>"))
            assert kept.count(prose.strip()) == 3, (name, mark)
            gone = html_extract.extract(mark.format(f"<p>{prose}</p><section {name}><p>{short}</p><p><a>{prose}</a></p></section><p>{prose}</p>"))
            assert gone.count(prose.strip()) == 2 and short not in gone
    page = f"<article><h1>Title</h1><p>By me</p><div class=legal><p>{'w ' * 25}</p></div><p>{prose}</p><p>Bye</p></article><p>{prose} outside</p>"
    base = html_extract.extract(page)
    assert base == f"Title\nBy me\n{prose.strip()}\nBye"
    assert "w w w" in html_extract.extract(page, surge=40) and html_extract.extract(page, surge=10**6, share=1.1) == ""
    bare = f"<p>Short start</p><p><a>x</a></p><p><a>y</a></p><p>{prose}</p><p>end</p><p><a>z</a></p><p>late</p>"
    assert html_extract.extract(bare, window=1) == f"{prose.strip()}\nend" != html_extract.extract(bare)
