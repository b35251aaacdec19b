"""Language-model scores of texts, beside a smoothed word base.

Model: one layer of causal self-attention with a feed-forward part, in numpy, on subword ids. It predicts the class of the next id
(ids are clustered by their neighbours); ids have probabilities within their class, given the class of the id before. A text is cut into windows that overlap: each
id, and the end after the last, is scored once, with at least CONTEXT ids before it where the text has them; windows go through masked
attention in batches.

The classes of ids and the probabilities within classes come from the pairs of neighbouring ids of all training texts, counted into a table in the
shared folder; what the driver takes from it is summed to at most vocabulary x CLASSES numbers. In the same pass the tasks cut all
training texts, of any length, into windows, which go to the shared folder too. The attention's weights are fitted to all of them by
gradient steps. Up to 2 * LEAST windows, the driver takes the steps, each window once or in turns. Of more, it takes the first steps by
about LEAST of them, to give the tasks a common start; then all windows go through ROUNDS rounds, each window in one of them: windows
are dealt by hashes of text and place into shards of about SHARD windows (MOST shards a round at most, larger ones then), each shard takes its steps
from the round's weights, and the mean of the shards' weights, by their windows, is the next round's. The base covers all training texts too: each task turns a chunk of texts into distinct words with counts and sends them,
in blocks by hash range, to be summed; the sums come back to the chunk, which scores its texts. Words are counted by 64-bit hashes.

Null and empty texts are the end alone. Null ids are not held out, so train. Rows that repeat an id are texts of their own. An
empty table gives none; other columns are ignored. If no text trains, the model is uniform over ids.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens
from .common import U64
from .ngram_join import MOVED, _delta, _planes, _undelta, _unplanes, hash_range

LEAST, SHARD, ROUNDS, MOST, PARTS = 38_400, 4_800, 8, 1024, 16
WINDOW, CONTEXT, CLASSES, WIDTH, HIDDEN, INPUTS = 64, 32, 128, 32, 64, 4096
STEP = WINDOW - CONTEXT
PAIRS_HELD, STEPS, RATE = 4 << 20, 800, 4e-3
TOGETHER, SPAN = 12, 1 << 14
CHUNK_BYTES, CHUNK_TEXTS = 24 << 20, 60_000


# --------------------------------------------------------------------------- the model


class Pairs:
    """How often one id follows another, from texts in memory."""

    def __init__(self, texts: list[np.ndarray], end: int):
        self.next = np.concatenate(texts)
        self.prev = np.concatenate([np.concatenate([[end], t[:-1]]) for t in texts])

    def sums(self, left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct left[previous id] * width + right[id], and their numbers of pairs."""
        return np.unique(left[self.prev] * width + right[self.next], return_counts=True)


class CorpusPairs:
    """The same, from all training texts, as a table (p, i, c) in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, share: float = 0):
        rows = docs.where(~held_out(id_col)).select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"), F.col(text_col).alias("t"))
        found = rows.mapInArrow(_count_pairs(vocabulary, share), "p int, i int, c long, h long, w binary")
        found = common.stored(found.withColumn("round", F.coalesce(self._place(ROUNDS).cast("int"), F.lit(-1))), "windows", ("round",))
        self.found = found
        self.windows = found.where("round >= 0").select("h", "w", "round")
        self.table = common.stored(found.where("round < 0").groupBy("p", "i").agg(F.sum("c").alias("c")), "pairs")

    def drawn(self, share: float = 1):
        """The windows, or a share of them, in an order by hash: rows of the id before and WINDOW ids, -1 after the text's end."""
        rows = self.windows if share == 1 else self.windows.where(self._place(1 << 30) < int(share * (1 << 30)))
        for row in rows.orderBy("h", "w").toLocalIterator():
            yield np.frombuffer(row["w"], np.int32)

    @staticmethod
    def _place(n: int):
        """Which of n equal parts a window's hash is in."""
        return F.floor(F.shiftrightunsigned("h", 11) * float(n / (1 << 53)))

    def in_round(self, i: int, shards: int) -> DataFrame:
        """The windows of a round, with their shards (s)."""
        at = self._place(ROUNDS * shards).cast("int")
        return self.windows.where(F.col("round") == i).select("h", "w", at.alias("s")).repartition(3 * shards, "s")  # so that few share one

    def sums(self, left, right, width):
        def run(batches):
            for b in batches:
                p, i, c = (b.column(j).to_numpy() for j in range(3))
                keys, which = np.unique(left[p].astype(np.int64) * width + right[i], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(which, c, len(keys)).astype(np.int64))], ["k", "c"])

        got = self.table.mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).orderBy("k").toArrow()
        return got.column("k").to_numpy(), got.column("c").to_numpy()


def _draw(ids: np.ndarray, upto: np.ndarray, seeds: np.ndarray, share: float, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows (see CorpusPairs.drawn) of a share of all windows of texts (ids with the end, laid end to end)."""
    n = np.diff(upto)
    each = -(-n // WINDOW)
    text = np.repeat(np.arange(len(n)), each)
    place = (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * WINDOW
    h = common.mix(seeds.view(U64)[text] + common.mix(place.astype(U64) + U64(1)))
    pick = (h >> U64(11)) < U64(int(share * (1 << 53)))
    h, text, place = h[pick], text[pick], place[pick]
    grid = (upto[text] + place)[:, None] + np.arange(-1, WINDOW)
    out = ids[np.clip(grid, 0, len(ids) - 1)].astype(np.int32)
    out[place == 0, 0] = end
    out[grid >= upto[text + 1][:, None]] = -1
    return h.view(np.int64), out


def _count_pairs(vocabulary, share: float):
    """Rows (p, i, c) of pairs, and rows (h, w) of the windows drawn."""

    def windows(h, rows):
        none = pa.nulls(len(h), pa.int32())
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(h), pa.int64()), pa.array(h), pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(np.arange(len(h) + 1, dtype=np.int32) * np.int32(4 * (WINDOW + 1))), pa.py_buffer(np.ascontiguousarray(rows))])], ["p", "i", "c", "h", "w"])

    def run(batches):
        enc, held, n = tokens.encoder(vocabulary), [], 0
        end = enc.library.get_vocab_size()

        def out():
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            for j in range(0, len(keys), 1 << 16):
                k = keys[j : j + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((k // (end + 1)).astype(np.int32)), pa.array((k % (end + 1)).astype(np.int32)), pa.array(c[j : j + (1 << 16)]), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.binary())], ["p", "i", "c", "h", "w"])

        for batch in batches:
            seeds = batch.column(0).to_numpy()
            for i, j, data, bounds in common.pieces(common.text_column(batch, "t")):
                sub, at = enc.encode(data, bounds)
                ids = np.insert(sub.astype(np.int64), at[1:], end)
                held.append(np.concatenate([[end], ids[:-1]]) * (end + 1) + ids)  # each text follows the end of another, or the start
                n += len(ids)
                if share:
                    yield windows(*_draw(ids, at + np.arange(len(at)), seeds[i:j], share, end))
                if n > PAIRS_HELD:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    return run


def _cluster(pairs, count: np.ndarray, k: int) -> np.ndarray:
    """A class for each id: frequent ids alone, others by their neighbours' distribution."""
    n = len(count)
    order = np.argsort(-count, kind="stable")
    alone = min(k // 2, n)
    cls = np.full(n, k - 1, np.int64)
    cls[order[:alone]] = np.arange(alone)
    rest = order[alone:][count[order[alone:]] >= 3]
    if len(rest) and k - 1 - alone > 0:
        near = np.zeros((n, 2 * alone + 2), np.float32)
        column = np.full(n, alone)
        column[order[:alone]] = np.arange(alone)
        keys, c = pairs.sums(column, np.arange(n), n)
        near[keys % n, keys // n] = c
        keys, c = pairs.sums(np.arange(n), column, alone + 1)
        near[keys // (alone + 1), alone + 1 + keys % (alone + 1)] = c
        x = near[rest]
        x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
        r, groups = np.random.default_rng(3), min(k - 1 - alone, len(rest))
        c = x[r.choice(len(rest), groups, replace=False, p=count[rest] / count[rest].sum())]
        for _ in range(6):
            best = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
            total, w = np.zeros_like(c), np.bincount(best, count[rest], groups)
            np.add.at(total, best, x * count[rest][:, None].astype(np.float32))
            c = np.where(w[:, None] > 0, total / np.maximum(w, 1)[:, None], c).astype(np.float32)
        cls[rest] = alone + best
    return cls


def _norm(x):
    r = _dots(x, x)
    r *= np.float32(1 / x.shape[-1])
    r += np.float32(1e-5)
    r = (np.float32(1) / np.sqrt(r))[..., None]
    return x * r, r


def _normed(x):
    return _norm(x)[0]


def _norm_back(dy, y, r):
    """By what the normed rows y, made with the factors r, hand back; in place of dy."""
    dy -= y * (_dots(dy, y) * np.float32(1 / y.shape[-1]))[..., None]
    dy *= r
    return dy


def _dots(x, y):
    return np.einsum("...j,...j->...", x, y)


def _by(x, w):
    """x @ w as one product."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def _flat(arrays: dict) -> np.ndarray:
    """All arrays in one."""
    return np.concatenate([x.ravel() for x in arrays.values()])


def _views(flat: np.ndarray, like: dict) -> dict:
    """Such an array's parts, in the shapes of `like`."""
    cut = np.cumsum([0] + [x.size for x in like.values()])
    return {k: flat[a:b].reshape(x.shape) for (k, x), a, b in zip(like.items(), cut[:-1], cut[1:], strict=True)}


def _in_turns(drawn, batch: int):
    """Batches of ids before, ids, and which of them are there, from rows that drawn() gives as often as needed."""
    rows = []
    while True:
        for row in drawn():
            rows.append(row)
            if len(rows) == batch:
                grid, rows = np.stack(rows).astype(np.int64), []
                valid = grid[:, 1:] >= 0
                grid = np.maximum(grid, 0)
                yield grid[:, :-1], grid[:, 1:], valid


def _at_random(texts: list[np.ndarray], r: np.random.Generator, batch: int, end: int):
    """The same from random places of texts."""
    ids, starts = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    prev = np.concatenate([np.concatenate([[end], t[:-1]]) for t in texts])
    while True:
        at = r.integers(0, len(ids), batch)
        t = np.searchsorted(starts, at, "right") - 1
        at = np.maximum(np.minimum(at, starts[t + 1] - WINDOW), starts[t])
        grid = at[:, None] + np.arange(WINDOW)
        valid = grid < starts[t + 1][:, None]
        grid = np.minimum(grid, len(ids) - 1)
        yield prev[grid], ids[grid], valid


_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def _shard(sent, rates: tuple[float, float], batch: int):
    """A shard's windows: steps with each of them once, from the round's weights to the shard's, times its windows."""

    def run(key, table):
        common.keep_memory()
        table = table.combine_chunks()
        w = table.column("w").chunk(0)
        at = np.frombuffer(w.buffers()[1], np.int32)[w.offset : w.offset + len(w) + 1]
        grid = np.frombuffer(w.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.int32).reshape(len(w), WINDOW + 1)
        rows = grid[np.argsort(table.column("h").to_numpy(), kind="stable")]
        light = sent.value
        m = Model(light.end)
        m.cls, m.input = light.cls, light.input
        m.params, m.squares = light.params, light.squares  # the steps copy them
        steps = -(-len(rows) // batch)
        cut = np.linspace(0, len(rows), steps + 1).astype(int)

        def draws():
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                part = rows[a:b].astype(np.int64)
                valid = part[:, 1:] >= 0
                part = np.maximum(part, 0)
                yield part[:, :-1], part[:, 1:], valid

        m._steps(draws(), steps, lambda s: rates[0] + (rates[1] - rates[0]) * s / steps, 1000)
        flat = np.concatenate([x.ravel() for x in m.params.values()]) * len(rows)
        return pa.table({"s": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(rows)]), "w": pa.array([flat.astype(np.float32).tobytes()], pa.binary())})

    return run


def _total(key, table):
    """Shards' weights summed in the shards' order."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("s", "n", "w")), strict=True), key=lambda x: x[0])
    total = np.zeros(len(rows[0][2]) // 4)
    for _, _, w in rows:
        total += np.frombuffer(w, np.float32)
    return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(x[1] for x in rows)]), "w": pa.array([total.tobytes()], pa.binary())})


class Model:
    def __init__(self, end: int):
        self.end, self.params, self.space = end, None, None  # uniform

    def fit(self, texts: list[np.ndarray] | None = None, steps: int = STEPS, batch: int = 48, seed: int = 7, pairs: CorpusPairs | None = None) -> "Model":
        """By texts in memory (ids with the end), or by pairs and all windows of a corpus, which may take more steps."""
        n, r = self.end + 1, np.random.default_rng(seed)
        if texts is None:
            given = pairs.windows.count()
            held = list(pairs.drawn(1 if given <= 2 * LEAST else LEAST / given))
            steps, draws = max(steps, -(-len(held) // batch)), _in_turns(lambda: (held[i] for i in r.permutation(len(held))), batch)
        else:
            draws = _at_random(texts, r, batch, self.end)
        pairs = pairs or Pairs(texts, self.end)
        keys, c = pairs.sums(np.zeros(n, np.int64), np.arange(n), n)
        count = np.zeros(n, np.int64)
        count[keys] = c
        self.cls = _cluster(pairs, count, CLASSES)
        within = count + 0.1
        inner = within / np.bincount(self.cls, within, CLASSES)[self.cls]
        keys, c = pairs.sums(self.cls, np.arange(n), n)
        seen = np.bincount(keys // n * CLASSES + self.cls[keys % n], c, CLASSES * CLASSES).reshape(CLASSES, CLASSES)
        self.logp = np.log(20 * inner / (seen[:, self.cls] + 20)).astype(np.float32)  # backs off to the class alone
        a, i = keys // n, keys % n
        self.logp[a, i] = np.log((c + 20 * inner[i]) / (seen[a, self.cls[i]] + 20))
        order = np.argsort(-count, kind="stable")
        self.input = INPUTS + self.cls
        self.input[order[:INPUTS]] = np.arange(min(INPUTS, n))
        d, f32 = WIDTH, np.float32
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(f32)
        p = self.params = {"e": (r.standard_normal((INPUTS + CLASSES, d)) * 0.5).astype(f32), "pos": (r.standard_normal((WINDOW, d)) * 0.1).astype(f32), "qk": (init(d, d) @ init(d, d).T / np.sqrt(d)).astype(f32), "vo": init(d, d) @ init(d, d), "a": init(d, HIDDEN), "b": init(HIDDEN, d), "w": init(d, CLASSES), "c": np.log((np.bincount(self.cls, within, CLASSES) + 1e-3) / within.sum()).astype(f32)}
        self.squares = {k: np.zeros_like(x) for k, x in p.items()}
        many = texts is None and given > 2 * LEAST
        self._steps(draws, steps, lambda s: RATE * min(1, s / 30) * (1 if many else 1 - s / (steps + 1)) + 1e-5)
        self.trained = len(held) if texts is None else 0
        if many:
            self._rounds(pairs, given, batch)
        del self.squares
        self.space = None
        return self._fold()

    def _steps(self, draws, steps: int, rate, before: int = 0) -> None:
        """Gradient steps; those after `before` others start from their mean squares of gradients."""
        p, v = _flat(self.params), _flat(self.squares)
        m, g = np.zeros_like(p), np.zeros_like(p)
        parts, scratch = _views(g, self.params), np.empty(SPAN, np.float32)
        self.params, self.squares = _views(p, self.params), _views(v, self.squares)
        for s in range(1, steps + 1):
            prev, ids, valid = next(draws)
            self._gradients(self.input[prev], self.cls[ids], valid, parts)
            a, b, c = np.float32(rate(s) / (1 - 0.9**s)), np.float32(1 - 0.98 ** (s + before)), np.float32(1e-8)
            for i in range(0, len(p), SPAN):  # few at a time, which stay in the processor's cache
                at = slice(i, i + SPAN)
                mi, vi, gi = m[at], v[at], g[at]
                d = scratch[: len(gi)]
                mi *= np.float32(0.9)
                mi += np.multiply(gi, np.float32(0.1), out=d)
                vi *= np.float32(0.98)
                gi *= gi
                gi *= np.float32(0.02)
                vi += gi
                np.divide(vi, b, out=d)
                np.sqrt(d, out=d)
                d += c
                np.divide(mi, d, out=d)
                d *= a
                p[at] -= d

    def _rounds(self, pairs: CorpusPairs, given: int, batch: int) -> None:
        """All windows of a corpus: see the module's docstring."""
        shards = min(MOST, max(1, -(-given // (ROUNDS * SHARD))))
        spark, self.trained = pairs.windows.sparkSession, 0
        for i in range(ROUNDS):
            light = Model(self.end)
            light.params, light.squares, light.cls, light.input = self.params, self.squares, self.cls, self.input
            sent = spark.sparkContext.broadcast(light)
            rates = RATE * (1 - i / ROUNDS), RATE * (1 - (i + 1) / ROUNDS) + 1e-5
            each = pairs.in_round(i, shards).groupBy("s").applyInArrow(_shard(sent, rates, batch), "s int, n long, w binary")
            with common.brief_shuffles(spark):
                parts = each.withColumn("g", F.col("s") % PARTS).groupBy("g").applyInArrow(_total, "g int, n long, w binary").collect()
            sent.destroy()
            if not parts:
                continue
            parts = sorted(parts, key=lambda x: x["g"])
            n = sum(x["n"] for x in parts)
            mean, at = sum(np.frombuffer(x["w"]) for x in parts) / n, 0
            for k, x in self.params.items():
                self.params[k] = mean[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
            self.trained += n

    def _fold(self) -> "Model":
        """Whether exponents are surely small enough to go without their maximum."""
        p = self.params
        bound = WIDTH * float(np.linalg.norm(p["qk"], 2)), float(np.sqrt(WIDTH) * np.linalg.norm(p["w"], axis=0).max() + np.abs(p["c"]).max())
        self.small = bound[0] < 60, bound[1] < 60  # normed rows are at most sqrt(WIDTH) long
        return self

    def _hidden(self, x_ids: np.ndarray, scored: np.ndarray | None, skip: int, space: tuple) -> np.ndarray:
        """What _forward gives as n3, for the scored places only; none of the first `skip` is scored, and if `scored` is None, all others are."""
        p = self.params
        b, t = x_ids.shape
        x = space[0][: b * t].reshape(b, t, WIDTH)
        np.take(p["e"], x_ids, 0, out=x, mode="clip")  # no id is clipped: the other mode copies
        x += p["pos"][:t]
        keys = _normed(x.reshape(-1, WIDTH)).reshape(b, t, WIDTH)
        att = space[1][: b * (t - skip) * t].reshape(b, t - skip, t)
        np.matmul(_by(keys[:, skip:], p["qk"]), keys.transpose(0, 2, 1), out=att)
        if not self.small[0] and not (att.max() < 60 and att.min() > -60):
            att += _MASK[skip:t, :t]
            att -= att.max(-1, keepdims=True)
        np.exp(att, out=att)
        att *= _SEEN[skip:t, :t]
        got = (att @ keys).reshape(-1, WIDTH)
        got *= (np.float32(1) / (att.reshape(-1, t) @ _SEEN[-1, :t]))[:, None]  # a product sums faster
        own = x[:, skip:]
        if scored is None:
            h = got @ p["vo"]
            h += own.reshape(-1, WIDTH)
        else:
            pick = scored[:, skip:]
            h = got[pick.ravel()] @ p["vo"]
            h += own[pick]
        u = _normed(h) @ p["a"]
        np.maximum(u, np.float32(0), out=u)
        h += u @ p["b"]
        return _normed(h)

    def _forward(self, x_ids, att=None, small: bool = False):
        """All that gradients need, attention as exponents; `share`, the last, is one over their sums."""
        p = self.params
        b, t = x_ids.shape
        x = p["e"].take(x_ids, 0)
        x += p["pos"][:t]
        n1, r1 = _norm(x)
        q = _by(n1, p["qk"])
        att = np.matmul(q, n1.transpose(0, 2, 1), out=att)
        if not small and not (att.max() < 60 and att.min() > -60):
            att += _MASK[:t, :t]
            att -= att.max(-1, keepdims=True)
        np.exp(att, out=att)
        att *= _SEEN[:t, :t]
        share = (np.float32(1) / (att.reshape(-1, t) @ _SEEN[-1, :t])).reshape(b, t, 1)  # a product sums faster
        av = att @ n1
        av *= share
        h = _by(av, p["vo"])
        h += x
        n2, r2 = _norm(h)
        u = _by(n2, p["a"])
        np.maximum(u, np.float32(0), out=u)
        z = _by(u, p["b"])
        z += h
        n3, r3 = _norm(z)
        return n1, r1, q, att, av, h, n2, r2, u, z, n3, r3, share

    def _gradients(self, x_ids, y, valid, out: dict | None = None):
        """By all parameters, of the mean loss of the valid places; windows go a few at a time, so that what they need stays in the cache."""
        p = self.params
        g = out or {k: np.zeros_like(x) for k, x in p.items()}
        for x in g.values():
            x[...] = 0
        b, t = y.shape
        few = min(b, TOGETHER)
        if self.space is None or self.space[0].shape[:2] != (few, t):
            self.space = np.empty((few, t, t), np.float32), np.empty((few, t, t), np.float32), np.empty((few * t, CLASSES), np.float32)
        small = WIDTH * float(np.sqrt((p["qk"] ** 2).sum())) < 60, float(np.sqrt(WIDTH) * np.linalg.norm(p["w"], axis=0).max() + np.abs(p["c"]).max()) < 60
        weight = (valid / valid.sum()).astype(np.float32)
        for i in range(0, b, few):
            some = x_ids[i : i + few]
            dz = self._part(some, y[i : i + few], weight[i : i + few], small, g)
            np.add.at(g["e"].reshape(-1), (some.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel(), dz.ravel())  # fast in one dimension
            g["pos"][:t] += dz.sum(0)
        return g

    def _part(self, x_ids, y, weight, small, g):
        """Adds some windows' gradients to g; gives those of their inputs. Sums of exponents divide narrow arrays, not the wide ones."""
        p = self.params
        b, t = y.shape
        att, ds, dl = self.space[0][:b], self.space[1][:b], self.space[2][: b * t]
        flat = lambda a: a.reshape(-1, a.shape[-1])
        n1, r1, q, att, av, _, n2, r2, u, _, n3, r3, share = self._forward(x_ids, att, small[0])
        across = n1.transpose(0, 2, 1)
        np.matmul(flat(n3), p["w"], out=dl)
        bias = p["c"]
        if not small[1]:
            dl += bias
            dl -= dl.max(-1, keepdims=True)
            bias = np.zeros_like(bias)
        np.exp(dl, out=dl)
        bias = np.exp(bias)  # as factors of exponents
        total, label = dl @ bias, y.ravel()
        dl[np.arange(b * t), label] -= total / bias[label]
        share_l = (weight.ravel() / total)[:, None]
        g["w"] += (dl.T @ (flat(n3) * share_l)).T * bias
        g["c"] += (share_l[:, 0] @ dl) * bias
        dz = dl @ (p["w"] * bias).T
        dz *= share_l
        dz = _norm_back(dz.reshape(n3.shape), n3, r3)
        g["b"] += flat(u).T @ flat(dz)
        du = _by(dz, p["b"].T)
        du *= u > 0
        g["a"] += (flat(du).T @ flat(n2)).T
        dz += _norm_back(_by(du, p["a"].T), n2, r2)
        g["vo"] += flat(av).T @ flat(dz)
        dav = _by(dz, p["vo"].T)
        dav *= share
        np.matmul(dav, across, out=ds)
        ds -= _dots(dav, av)[..., None]
        ds *= att
        dq = ds @ n1
        g["qk"] += flat(n1).T @ flat(dq)
        dn = _by(dq, p["qk"].T)
        dn += ds.transpose(0, 2, 1) @ q
        dn += att.transpose(0, 2, 1) @ dav
        dz += _norm_back(dn, n1, r1)
        return dz

    def log10(self, ids: np.ndarray, upto: np.ndarray, batch: int = 32) -> np.ndarray:
        """log10 probabilities of texts (ids with the end, laid end to end). Batches are small, to stay in the processor's cache."""
        n = np.diff(upto)
        if self.params is None:
            return -n * np.log10(self.end + 1.0)
        each = -(-n // STEP)
        text = np.repeat(np.arange(len(n)), each)
        s = (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * STEP
        a = np.maximum(s - CONTEXT, 0)
        stop = np.minimum(s + STEP, n[text])
        previous = np.concatenate([[self.end], ids[:-1]])
        previous[upto[:-1][n > 0]] = self.end
        x_in, y_cls = self.input[previous], self.cls[ids]
        bias = self.params["c"]
        known = self.logp[self.cls[previous], ids] + bias[y_cls]
        total, factors = np.zeros(len(text)), np.exp(bias)
        space = np.empty((batch * WINDOW, WIDTH), np.float32), np.empty(batch * WINDOW * WINDOW, np.float32), np.empty((batch * WINDOW, CLASSES), np.float32)
        full = stop - a == WINDOW  # then all after the first CONTEXT are scored
        order = np.flatnonzero(~full)
        order = order[np.argsort((stop - a)[order], kind="stable")]  # windows of like lengths go together
        for order, whole in (order, False), (np.flatnonzero(full), True):
            for i in range(0, len(order), batch):
                w = order[i : i + batch]
                if whole:
                    grid, scored, skip = (upto[text[w]] + a[w])[:, None] + np.arange(WINDOW), None, CONTEXT
                    y = grid[:, skip:].ravel()
                else:
                    grid, skip = a[w][:, None] + np.arange(int((stop - a)[w].max())), int((s - a)[w].min())
                    scored = (grid >= s[w][:, None]) & (grid < stop[w][:, None])
                    grid = np.minimum(grid, n[text[w]][:, None] - 1) + upto[text[w]][:, None]
                    y = grid[scored]
                rows, z = self._hidden(x_in[grid], scored, skip, space), space[2][: len(y)]
                np.matmul(rows, self.params["w"], out=z)
                if self.small[1] or (z.max() + bias.max() < 60 and z.min() + bias.min() > -60):
                    got = known[y] + z[np.arange(len(y)), y_cls[y]]
                    np.exp(z, out=z)
                    got -= np.log(z @ factors)  # the bias as factors of the sum
                else:
                    z += bias
                    top = z.max(-1)
                    z -= top[:, None]
                    got = known[y] - bias[y_cls[y]] + z[np.arange(len(y)), y_cls[y]]
                    got -= np.log(np.exp(z, out=z).sum(-1))
                total[w] = got.reshape(len(w), -1).sum(1, dtype=np.float64) if whole else np.bincount(np.nonzero(scored)[0], got, len(w))
        return np.bincount(text, total, len(n)) / np.log(10)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> Model:
    """A model: classes and their ids' probabilities, and the attention's weights, by all training texts."""
    n = docs.where(~held_out(id_col)).count()
    end = tokens.encoder(vocabulary).library.get_vocab_size()
    if not n:
        return Model(end)
    pairs = CorpusPairs(docs, id_col, text_col, vocabulary, 1.0)
    model = Model(end).fit(pairs=pairs)
    common.forget(pairs.found, pairs.table)
    return model


# --------------------------------------------------------------------------- the base, and both


class _Chunk:
    def __init__(self):
        self.ids, self.held, self.n, self.scores, self.words, self.bytes = [], [], [], [], [], 0

    def rows(self, name: str, ranges: int):
        n, held = np.array(self.n, np.int64), np.array(self.held, bool)
        words = np.concatenate(self.words) if self.words else np.zeros(0, U64)
        distinct, which = np.unique(words, return_inverse=True)
        times = np.bincount(which[~np.repeat(held, n)], minlength=len(distinct)).astype(np.uint32)
        at = np.concatenate([[0], np.searchsorted(distinct, np.arange(1, ranges, dtype=U64) * U64((1 << 64) // ranges)), [len(distinct)]])
        for r in np.flatnonzero(np.diff(at)).tolist():
            s = slice(at[r], at[r + 1])
            yield r, name, int(r) + 1, _delta(distinct[s]), _planes(times[s]), b""
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        head = np.concatenate([x.view(np.uint8) for x in (ids, np.array([i is None for i in self.ids]), held, n, np.concatenate(self.scores))]).tobytes()
        yield hash_range(name, ranges), name, -len(self.ids), head, _planes(which.astype(np.uint32)), b""


def _deal(model, vocabulary, ranges: int):
    def run(batches):
        common.keep_memory()
        enc, m = tokens.encoder(vocabulary), model.value
        chunk, serial, task = _Chunk(), 0, TaskContext.get().partitionId()

        def out():
            nonlocal chunk, serial
            rows = list(chunk.rows(f"{task}-{serial}", ranges))
            chunk, serial = _Chunk(), serial + 1
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["r", "chunk", "n", "a", "b", "c"])

        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j, data, bounds in common.pieces(common.text_column(batch, "t")):
                if chunk.ids and (chunk.bytes + len(data) > CHUNK_BYTES or len(chunk.ids) + j - i > CHUNK_TEXTS):
                    yield from out()
                starts, ends, upto = common.words_of(data, bounds)
                chunk.words.append(common.segment_hashes(data, starts, ends))
                chunk.n += np.diff(upto).tolist()
                sub, at = enc.encode(data, bounds)
                sub = np.insert(sub.astype(np.int64), at[1:], m.end)
                chunk.scores.append(m.log10(sub, at + np.arange(len(at))))
                chunk.ids += ids[i:j]
                chunk.held += held[i:j]
                chunk.bytes += len(data)
        if chunk.ids:
            yield from out()

    return run


def _sum(key, rows):
    """A hash range: each word's training count goes back to the chunks that have it; the range's own totals go along."""
    heads, blocks = rows[rows.n < 0], rows[rows.n > 0]
    if not len(blocks):
        return heads
    each = [_undelta(a) for a in blocks.a]
    size = np.array(list(map(len, each)))
    words, which = np.unique(np.concatenate(each), return_inverse=True)
    c = np.bincount(which, np.concatenate([_unplanes(b, np.uint32) for b in blocks.b]), len(words)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    back = [(0, name, n, _planes(c[which[at[i] : at[i + 1]]]), b"", b"") for i, (name, n) in enumerate(zip(blocks.chunk, blocks.n, strict=True))]
    back.append((0, f"total-{key[0]}", 0, np.array([(c > 0).sum(), c.sum()], np.int64).tobytes(), b"", b""))
    return pd.concat([heads, pd.DataFrame(back, columns=list(rows.columns))], ignore_index=True)


def _regroup(key, rows):
    columns = {"doc_id": "Int64", "held_out": "boolean", "words": "int64", "known": "int64", "base": "float64", "score": "float64", "v": "int64", "t": "int64"}
    if rows.n.iloc[0] == 0:
        v, t = np.frombuffer(rows.a.iloc[0], np.int64)
        return pd.DataFrame({"doc_id": [None], "held_out": [None], "words": [0], "known": [0], "base": [0.0], "score": [0.0], "v": [v], "t": [t]}).astype(columns)
    head = rows[rows.n < 0].iloc[0]
    m = -int(head.n)
    buf = np.frombuffer(head.a, np.uint8)
    cut = np.cumsum([0, 8 * m, m, m, 8 * m, 8 * m])
    ids, null, held, n, score = (buf[a:b].copy().view(t) for a, b, t in zip(cut[:-1], cut[1:], (np.int64, bool, bool, np.int64, np.float64), strict=True))
    blocks = rows[rows.n > 0].sort_values("n")
    c = np.concatenate([_unplanes(a, np.int64) for a in blocks.a]) if len(blocks) else np.zeros(0, np.int64)
    which = _unplanes(head.b, np.uint32)
    owner = np.repeat(np.arange(m), n)
    known = np.bincount(owner, (c > 0)[which], m).astype(np.int64)
    base = np.bincount(owner, np.log10(c + 0.1)[which], m)
    out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": held, "words": n, "known": known, "base": base, "score": score, "v": -1, "t": -1})
    out.loc[null, "doc_id"] = pd.NA
    return out.astype(columns)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model or train(docs, id_col, text_col, vocabulary))
    ranges = min(max(128, common.input_bytes(docs) >> 22), 1 << 16)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), held_out(id_col).alias("h"), F.col(text_col).alias("t"))
    summed = rows.mapInArrow(_deal(held, vocabulary, ranges), MOVED).groupBy("r").applyInPandas(_sum, MOVED)
    kind = "doc_id long, held_out boolean, words long, known long, base double, score double, v long, t long"
    found = common.stored(summed.groupBy("chunk").applyInPandas(_regroup, kind), "scores")
    texts = found.where("v < 0")
    t = found.where("v >= 0").agg(F.sum("v"), F.sum("t")).first()
    ends = texts.where("not held_out").count()  # each training text has an end
    n, v = (t[1] or 0) + ends, (t[0] or 0) + (ends > 0)
    under = float(np.log10(n + 0.1 * (v + 1)))
    base = F.col("base") + float(np.log10(ends + 0.1)) - F.col("n_tokens") * under
    texts = texts.withColumn("n_tokens", F.col("words") + 1)
    return texts.select("doc_id", "held_out", "n_tokens", (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
