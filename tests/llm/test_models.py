import math
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases

from lodestar.llm import lm, quality, vectors

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------------------- embeddings


def brute_near(rows):
    """(id, n_links, component, kept) of each row, rows of one id apart."""
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {k: (lambda x: x / np.linalg.norm(x))(np.array(rows[k][1], float) / np.abs(rows[k][1]).max()) for k in ok}
    links = {k: {j for j in ok if j != k and len(unit[j]) == len(unit[k]) and unit[k] @ unit[j] >= 0.9} for k in ok}
    root = {k: rows[k][0] for k in ok}
    for _ in ok:
        for a in ok:
            for b in links[a]:
                root[a] = root[b] = min(root[a], root[b])
    return [(i, len(links.get(k, ())), root.get(k, i), root.get(k, i) == i) for k, (i, v) in enumerate(rows) if i is not None]


@pytest.mark.parametrize(("kind", "lists"), [("float", 4096), ("double", 4096), ("float", 3)])
def test_near_duplicates(spark, monkeypatch, kind, lists):
    monkeypatch.setattr(vectors, "PER_LIST", 20)
    monkeypatch.setattr(vectors, "LISTS", lists)  # 3: lists are cut by the second codebook
    monkeypatch.setattr(vectors, "MEMBERS", 40)
    monkeypatch.setattr(vectors, "QUERIES", 50)
    monkeypatch.setattr(vectors, "NEAR", 3)
    r = np.random.default_rng(2)
    base = r.standard_normal((150, 16))
    near = base[:10].repeat(8, 0) + r.standard_normal((80, 16)) * 0.25
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]).astype(np.float32))]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [0.0] * 14), (2004, []), (None, rows[0][1]), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (2007, [float("inf")] * 16)]
    rows += [(1, rows[7][1]), (1, rows[20][1]), (20, rows[7][1]), (3000, [1.0, 0.0, 0.0]), (3000, [0.0, 1.0, 0.0]), (3001, [1.0, 0.1, 0.0])]  # ids of several vectors
    if kind == "double":
        rows += [(4000, [1e39, 0.0, 0.0]), (4001, [1e39, 1e37, 0.0]), (4002, [1e-300, 0.0, 1e-301]), (4003, [1e300, 0.0, 0.0])]
    table = spark.createDataFrame([(*x, 1, 0.5) for x in rows], f"vec_id long, embedding array<{kind}>, label int, n_links double")
    found = vectors.near_duplicates(table, probes=10**6)
    got = sorted(tuple(x) for x in found.collect() if x["vec_id"] is not None)
    assert got == sorted(brute_near(rows))
    assert found.count() == len(rows)
    few = vectors.near_duplicates(table, probes=2)
    assert vectors.recall(table.where("vec_id < 2000 and vec_id not in (1, 20)"), few) >= 0.9
    assert vectors.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("lists", [(170, 1), (1000, 1), (4096, 1), (256, 64)])
def test_recall_with_growth(lists, monkeypatch):
    """Pairs at a cosine of 0.9 in random directions, the hardest there are: found by either, at numbers of lists that stand for up to five million vectors."""
    coarse, fine = lists
    monkeypatch.setattr(vectors, "PER_LIST", 1)
    monkeypatch.setattr(vectors, "LISTS", coarse if fine > 1 else 4096)
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(r.standard_normal((1500, 64)))
    other = r.standard_normal((1500, 64))
    other = unit(other - (other * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * other
    index = vectors.Index(unit(r.standard_normal((8000, 64))), coarse * fine, 16)
    (a, pa), (b, pb) = index.near(x.astype(np.float32)), index.near(y.astype(np.float32))
    assert index.lists == coarse * fine
    assert ((pa == b[:, None]).any(1) | (pb == a[:, None]).any(1)).mean() >= 0.9


# ---------------------------------------------------------------------------- the line field


def test_marginals_are_exact():
    r = np.random.default_rng(1)
    n = [3, 0, 1, 4]
    at = np.cumsum([0, *n])
    u, t = r.standard_normal(at[-1]), r.standard_normal((2, 2))
    got = quality.marginals(u, t, at)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if a == b:
            continue
        weights = {}
        for y in np.ndindex(*[2] * (b - a)):
            s = sum(u[a + i] * y[i] for i in range(b - a)) + sum(t[y[i], y[i + 1]] for i in range(b - a - 1))
            weights[y] = math.exp(s)
        for i in range(b - a):
            assert abs(got[a + i] - sum(w for y, w in weights.items() if y[i]) / sum(weights.values())) < 1e-9


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.95
    odd, data = cases.documents(spark)
    scored = quality.score(odd, model)
    assert scored.count() == len(data) and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert {r["score"] for r in scored.where("doc_id in (190, 191, 192)").collect()} == {0.0}
    kept = quality.good(odd, model)
    assert kept.columns == odd.columns and kept.count() == scored.where("predicted = 1").count()
    assert quality.score(odd.limit(0), quality.fit(odd, labels.limit(0))).count() == 0


# ---------------------------------------------------------------------------- the language model


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(0)
    texts = [np.append(np.cumsum(r.integers(1, 3, 80)) % 50, 60) for _ in range(150)]
    return lm.Model(60).fit(texts, steps=150), texts


def test_windows_score_each_token_once(model):
    m, texts = model
    flat, upto = np.concatenate(texts[:20]), np.cumsum([0, *map(len, texts[:20])])
    together = m.log10(flat, upto)
    assert np.allclose(together, [m.log10(t, np.array([0, len(t)]))[0] for t in texts[:20]], atol=1e-3)
    assert np.allclose(together, m.log10(flat, upto, batch=3), atol=1e-3)
    # it has learned steps of one or two: under half a digit an id, against 1.7 for equal ids
    assert together.sum() / len(flat) > -0.6


def test_probabilities_sum_to_one(model):
    m, texts = model
    start = texts[0][:10]
    total = sum(10 ** (m.log10(np.append(start, i), np.array([0, 11]))[0] - m.log10(start, np.array([0, 10]))[0]) for i in range(61))
    assert abs(total - 1) < 1e-3


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 40_000)
    docs, data = cases.documents(spark)
    fitted = lm.Model(49408)
    got = lm.score(docs, model=fitted).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    words = [[w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (d[1] or "").translate(LOW))] + [""] for d in data]
    c = Counter(w for d, ws in zip(data, words, strict=True) if not held(d[0]) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((d[0] if d[0] is not None else -1, held(d[0]), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for d, w in zip(data, words, strict=True)))
    mine = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    for a, b in zip(mine, want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * abs(b[5])
    assert all(r["score"] < 0 for r in got)
    assert lm.score(docs.limit(0)).count() == 0


def test_pairs_of_the_corpus(spark):
    docs, data = cases.documents(spark)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    enc = lm.tokens.encoder().library
    end = enc.get_vocab_size()
    texts = [np.array([*enc.encode(d[1] or "", add_special_tokens=False).ids, end]) for d in data if not held(d[0])]
    here, there = lm.Pairs(texts, end), lm.CorpusPairs(docs, "doc_id", "text", None)
    all_ids, few = np.arange(end + 1), np.arange(end + 1) % 7
    for args in ((0 * all_ids, all_ids, end + 1), (few, all_ids, end + 1), (all_ids, few, 7)):
        for a, b in zip(here.sums(*args), there.sums(*args), strict=True):
            assert np.array_equal(a, b)
    fitted = lm.train(docs)
    assert lm.train(docs.limit(0)).params is None
    assert np.allclose(np.bincount(fitted.cls, minlength=lm.CLASSES).sum(), end + 1)


def test_windows_of_the_corpus(spark):
    docs, data = cases.documents(spark)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    enc = lm.tokens.encoder().library
    end = enc.get_vocab_size()
    texts = [[*enc.encode(d[1] or "", add_special_tokens=False).ids, end] for d in data if not held(d[0])]
    want = Counter((end if a == 0 else t[a - 1], *t[a : a + lm.WINDOW]) for t in texts for a in range(0, len(t), lm.WINDOW))
    every = [tuple(x for x in w.tolist() if x >= 0) for w in lm.CorpusPairs(docs, "doc_id", "text", None, 1.0).drawn()]
    assert Counter(every) == want  # texts of any length
    some = lm.CorpusPairs(docs, "doc_id", "text", None, 0.25).windows.count()
    assert 0.2 * len(every) < some < 0.3 * len(every)


def test_all_windows_train(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST", 40)
    monkeypatch.setattr(lm, "SHARD", 64)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = lm.CorpusPairs(docs, "doc_id", "text", None, 1.0)
    every = Counter(bytes(r["w"]) for r in pairs.windows.collect())
    n = sum(every.values())
    assert n > 8 * 64 and sum((Counter(bytes(r["w"]) for r in pairs.in_round(i, 3).collect()) for i in range(lm.ROUNDS)), Counter()) == every
    assert 20 < len(list(pairs.drawn(40 / n))) < 60
    fitted, again = lm.train(docs), lm.train(docs.repartition(5))
    assert fitted.trained == again.trained == n  # steps are taken with every window
    assert all(np.array_equal(x, again.params[k]) for k, x in fitted.params.items())  # however the rows are dealt
    few = lm.Model(fitted.end)
    monkeypatch.setattr(lm.Model, "_rounds", lambda *_: None)
    few.fit(pairs=pairs)
    grids = [(np.maximum(g, 0), g[1:] >= 0) for g in (np.frombuffer(w, np.int32) for w in every)]
    loss = lambda m: -sum(np.log(p[np.arange(lm.WINDOW), m.cls[g[1:]]])[ok].sum() for g, ok in grids for p in [_classes(m, m.input[g[None, :-1]])])
    assert loss(fitted) < loss(few)


def _classes(m, x_ids):
    z = np.exp(m._forward(x_ids)[10][0].astype(float) @ m.params["w"] + m.params["c"])
    return z / z.sum(1, keepdims=True)


def test_gradients(model):
    m, texts = model
    x, y, ok = next(lm._at_random(texts, np.random.default_rng(5), 4, 60))
    x, y, ok = m.input[x], m.cls[y], ok & (np.arange(lm.WINDOW) < 50)
    loss = lambda: -sum(np.log(_classes(m, x[i : i + 1])[np.arange(lm.WINDOW), y[i]])[ok[i]].sum() for i in range(4)) / ok.sum()
    g, r = m._gradients(x, y, ok), np.random.default_rng(6)
    for k, old in list(m.params.items()):
        way = (g[k] / np.sqrt((g[k] ** 2).sum()) + 0.1 * r.standard_normal(old.shape) / np.sqrt(old.size)).astype(np.float32)
        m.params[k] = old + np.float32(3e-3) * way
        up = loss()
        m.params[k] = old - np.float32(3e-3) * way
        slope, m.params[k] = (up - loss()) / 6e-3, old
        assert abs(slope - (g[k] * way).sum()) < 0.02 * abs(slope) + 1e-5


def test_steps_and_scores_take_few_windows_at_a_time(model, monkeypatch):
    m, texts = model
    x, y, ok = next(lm._at_random(texts, np.random.default_rng(8), 48, 60))
    x, y, text = m.input[x], m.cls[y], np.tile(np.append(np.arange(50), 60), 400)
    for run, most in (lambda: m._gradients(x, y, ok), 4 << 20), (lambda: m.log10(text, np.array([0, len(text)])), 5 << 20):
        m.space = None
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most
    whole, score = m._gradients(x, y, ok), m.log10(text[:3000], np.array([0, 3000]))[0]
    for few in 48, 7, 1:  # with the same results
        monkeypatch.setattr(lm, "TOGETHER", few)
        assert all(np.abs(g - whole[k]).max() < 1e-5 * np.abs(whole[k]).max() for k, g in m._gradients(x, y, ok).items())
        assert abs(m.log10(text[:3000], np.array([0, 3000]), few)[0] - score) < 1e-3


def test_long_texts_train(spark):
    long = "one two three four " * 4000
    docs = spark.createDataFrame([(i, long) for i in range(1, 4)], "doc_id long, text string")
    assert lm.train(docs).params is not None


def test_windows_overlap_by_half(model):
    m, _ = model
    assert lm.CONTEXT * 2 >= lm.WINDOW
    # each id of a long text has the probability that it has in the whole of its window, with half a window before it
    text = np.append(np.cumsum(np.random.default_rng(4).integers(1, 3, 200)) % 50, 60)
    prev, want = np.append(60, text[:-1]), 0.0
    for at in range(len(text)):
        a = max(at // lm.STEP * lm.STEP - lm.CONTEXT, 0)
        assert at - a >= min(at, lm.WINDOW // 2)
        z = m._forward(m.input[prev[None, a : at + 1]])[10][0, -1] @ m.params["w"] + m.params["c"]
        want += z[m.cls[text[at]]] - np.log(np.exp(z).sum()) + m.logp[m.cls[prev[at]], text[at]]
    assert abs(m.log10(text, np.array([0, len(text)]))[0] - want / np.log(10)) < 1e-2
