"""Near duplicates, toxicity and the pipeline, by brute force and on planted cases."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from annalist.llm import ngram_join, toxicity


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def mutated(rng, t, k):
    w = t.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
    return " ".join(w)


def brute(rows):
    sets_ = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets_[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets_}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets_)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets_[a] & sets_[b])
            if both and 100 * both >= 80 * len(sets_[a] | sets_[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets_[i]), find(i)) for i in sets_}


def corpus(seed):
    rng, rows = random.Random(seed), []
    for n in (1, 3, 4, 5, 6, 7, 9, 12, 20, 40, 90, 200, 500):
        for _ in range(2):
            t = text_of(rng, n)
            rows += [t, t.upper(), *(mutated(rng, t, k) for k in (1, 1, 2, 3, 5, 8))]
    chain = text_of(rng, 150)  # a family in which each is near the next
    for _ in range(30):
        chain = mutated(rng, chain, 1)
        rows.append(chain)
    shared = text_of(rng, 60)  # a passage of many documents
    rows += [f"{text_of(rng, 100)} {shared} {text_of(rng, 100)}" for _ in range(20)]
    rows += [None, "", "  ", "x", "X", "a b", "a b"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_all_pairs(spark, seed):
    rows = corpus(seed)
    d = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_shingles string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(d, block_bytes=20_000).collect()}
    assert got == brute(rows)


def test_join_empty_and_representatives(spark):
    d = spark.createDataFrame([(3, "a b c d e f"), (1, "A b c d e f"), (2, "other"), (2, "other")], "doc_id long, text string")
    assert ngram_join.join(d.where("false")).count() == 0
    assert sorted(r["doc_id"] for r in ngram_join.representatives(d).collect()) == [1, 2]
    assert ngram_join.representatives(d.where("false")).count() == 0


def test_representatives_of_odd_rows(spark):
    """Equal ids with different texts, rows without ids, repeated rows, empty texts, clashing columns."""
    a, b, c = "a b c d e f g h i j k", "l m n o p q r s t u v", "1 2 3 4 5 6 7 8 9"
    rows = [(2, a), (2, b), (None, b), (None, c), (None, c.upper()), (7, None), (7, ""), (7, a), (9, c + " x"), (5, "z " * 9), (5, "z " * 9)]
    d = spark.createDataFrame([(i, t, "p", "q") for i, t in rows], "doc_id long, text string, k string, row string").repartition(3)
    kept = ngram_join.representatives(d)
    assert kept.columns == d.columns
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    assert got == sorted([("2", a), ("2", b), ("7", ""), ("7", ""), ("9", c + " x"), ("5", "z " * 9)]) or got == sorted([("2", a), ("2", b), ("7", ""), ("7", ""), ("9", c + " x"), ("5", "z " * 9), ("None", c)])
    j = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.join(d).collect()}
    assert j[(7, 0)] == 7 and j[(7, 7)] == 2 and j[(None, 7)] == 2


def test_segments_guarantee():
    """Whatever is changed up to the bound, two linked sets share a key."""
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9, 10, 11, 25, 60, 300, 2000):
        for _ in range(10):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            k = len(a)
            drop = rng.integers(0, k // 9 + 1)
            b = np.unique(np.concatenate([a[rng.permutation(k)[drop:]], rng.integers(0, 2**63, k // 9).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both):
                assert len(np.intersect1d(ngram_join.signatures(a)[0], ngram_join.signatures(b)[0]))


def test_parity_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (50, 80))
    x, y = (np.frombuffer(ngram_join.signatures(np.unique(np.concatenate([a, s])))[2], np.uint8) for s in (b[:10], b[5:30]))
    assert np.bitwise_count(x ^ y).sum() <= 25


def test_gradients():
    words = [b"idiot", b"good", b"day", b"moron", b"x"]
    m = toxicity.Model(words[:3], seed=1)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    places = np.full((3, toxicity.WINDOW), -1)
    places[0, :4], places[1, :2], places[2, :5] = [0, 1, 2, 3], [4, 1], [2, 2, 1, 0, 4]
    ids, grams = m.lookup(words), toxicity.Grams(words)
    y, w, drop = np.array([1.0, 0.0, 1.0]), np.ones(3), np.zeros(5, bool)
    g, _ = m.gradients(ids, grams, places, y, w, drop)
    rng = np.random.default_rng(0)
    for k in ("word", "out", "att", "v", "uf", "ub", "xf", "xb", "cf", "cb", "bias"):
        flat = m.p[k].reshape(-1)
        lo = m.p[k].shape[-1] if k == "word" else 0  # row 0 isn't learned
        for i in rng.integers(lo, flat.size, 4) if flat.size > 1 else [0]:
            old, out = flat[i], []
            for d in (1e-3, -1e-3):
                flat[i] = old + d
                out.append(m.gradients(ids, grams, places, y, w, drop)[1])
            flat[i] = old
            assert g[k].reshape(-1)[i] == pytest.approx((out[0] - out[1]) / 2e-3, rel=0.06, abs=2e-4), k


def planted(n=400, seed=0):
    rng, rows, labels = random.Random(seed), [], []
    common = [f"{a}{b}" for a in ("the", "of", "stone", "water", "light", "hour") for b in ("", "s", "er", "ly", "ing")]
    for i in range(n):
        w = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(3000)}" for _ in range(rng.randrange(12, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["idiot", "Moron,", "scum", "trashy###"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = planted()
    rows += [(1000, None), (1001, ""), (1002, "... ..."), (1003, "w1 " * 20_000 + "idiot scum moron idiot " + "w2 " * 20_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([*labels, (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(d, y).collect()}
    assert len(got) == len(rows)
    assert [got[i]["score"] for i in (1000, 1001, 1002)] == [0.0, 0.0, 0.0]
    held = [i for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held)
    truth = {i: t for i, _, t in labels}
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.9
    assert got[1003]["score"] > 0.7  # far behind the first windows
    nothing = toxicity.classify(d, y.where("toxic = 0"))
    assert {r["score"] for r in nothing.collect()} == {0.0}


def test_windows_overlap_and_cover():
    for n in (1, toxicity.WINDOW, toxicity.WINDOW + 1, 1000):
        s = list(toxicity.window_starts(n))
        assert s[0] == 0 and s[-1] + toxicity.WINDOW >= n and all(b - a < toxicity.WINDOW for a, b in zip(s, s[1:], strict=False))


def test_pipeline(spark, tmp_path):
    rows, labels = planted(240)
    clean = {i for i, t in rows if i % 3}
    item = " ".join(f"bench{i}" for i in range(12))
    base = rows[1][1]
    extra = [(500, base), (501, f"{text_of(random.Random(9), 40)} {item}"), (502, "too short"), (503, "# $ " * 40), (504, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + extra], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not kept & {500, 501, 502, 503, 504}
    assert len(kept & clean) >= 0.9 * len(clean)
    toxic = {i for i, _, t in labels if t}
    assert len(kept & toxic) <= 0.1 * len(toxic)
    assert len(corpus_pipeline.STAGES) == 5
