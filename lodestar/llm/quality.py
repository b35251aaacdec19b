"""Document quality by a linear-chain conditional random field over lines.

Each line has numbers that describe its characters and words, and those of the lines before and after it. The field has two labels, good
and bad, with weights for these numbers and for neighbouring labels, fitted by gradient steps on the conditional likelihood with each
line of a labelled document labelled as its document. A document's score is the mean of its lines' marginal probabilities of good,
by forward and backward passes, weighted by the lines' lengths, and stretched by a logistic curve fitted to the documents.

Fitting takes a bounded sample, SAMPLE labelled documents of up to SAMPLE_BYTES bytes, by the hash of their ids; it learns from no
document of the held-out part. Scoring takes whole texts. Texts without words (null ones too) score 0. Without labels of both kinds the
score is the share of good ones, or 1 if there are none. Repeated ids count separately; ids with several labels take the lowest.
Null ids are not held out; other columns are ignored or passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, SAMPLE_BYTES = 3000, 1 << 16
THRESHOLD = 0.7
N = 20  # numbers for each line
_NEWLINE = np.zeros(256, bool)
_NEWLINE[[10, 13]] = True


def _kinds() -> list[np.ndarray]:
    b = np.arange(256)
    upper, lower = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122)
    symbol = np.isin(b, [ord(c) for c in "#$%&*@^~=<>{}[]\\_+`"])
    kinds = [upper | lower | (b >= 128), upper, (b >= 48) & (b <= 57), np.isin(b, [ord(c) for c in ".,;:?'\"-()"]), b == ord("|"), symbol, b == ord("!"), b >= 128]
    out = []
    for i in range(0, len(kinds), 2):  # two counters of 32 bits in a number
        out.append(kinds[i].astype(np.uint64) | kinds[i + 1].astype(np.uint64) << np.uint64(32))
    return out


_KINDS = _kinds()


def line_numbers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of lines (those with words), their lengths, and at which line each text begins."""
    ls, le, _ = common.words_of(data, bounds, _NEWLINE)
    ws, we, _ = common.words_of(data, bounds)
    line = np.searchsorted(ls, ws, "right") - 1
    has = np.bincount(line, minlength=len(ls)) > 0 if len(ls) else np.zeros(0, bool)
    renumber = np.cumsum(has) - 1
    ls, le, line = ls[has], le[has], renumber[line] if len(line) else line
    at = np.searchsorted(ls, bounds)
    if not len(ls):
        return np.zeros((0, N), np.float32), np.zeros(0), at
    counts = []
    edges = np.stack([ls, le], 1).ravel()
    edges = edges[:-1] if edges[-1] == len(data) else edges
    for table in _KINDS:
        both = np.add.reduceat(table[data], edges)[::2]
        counts += [(both & np.uint64(0xFFFFFFFF)).astype(float), (both >> np.uint64(32)).astype(float)]
    letters, upper, digits, marks, pipes, symbols, shouts, foreign = counts
    size = (le - ls).astype(float)
    n = np.bincount(line, minlength=len(ls)).astype(float)
    h = common.segment_hashes(data, ws, we)
    order = np.lexsort((h, line))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=len(ls))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    length = we - ws
    per = lambda m: np.bincount(line[m], minlength=len(ls)) / n
    last, first = data[we - 1], data[ws]
    text = np.searchsorted(at, np.arange(len(ls)), "right") - 1
    lh = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.searchsorted(line, line).astype(np.uint64) + np.uint64(1)), np.searchsorted(line, np.arange(len(ls))))
    order = np.lexsort((lh, text))
    same = np.zeros(len(ls), bool)
    eq = (lh[order][1:] == lh[order][:-1]) & (text[order][1:] == text[order][:-1])
    same[order[1:][eq]] = same[order[:-1][eq]] = True
    cols = [np.log1p(n) / 5, letters / size, upper / np.maximum(letters, 1), digits / size, marks / size, np.minimum(pipes / n, 1), np.minimum(symbols / n, 3), np.minimum(shouts / n, 3), foreign / size, 1 - distinct / n, per(again), size / n / 10, per(length <= 3), per(np.isin(last, [46, 44, 59, 58, 63])), per(np.isin(last, [35, 36, 37, 38, 42, 33, 124])), same.astype(float), (data[le - 1] == 46).astype(float), per((first >= 65) & (first <= 90)), per(length >= 15), (n <= 3).astype(float)]
    return np.stack(cols, 1).astype(np.float32), size, at


def with_neighbours(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Own numbers, the line before's, the line after's, whether there is none, and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    before[first] = after[last] = 0
    ends = np.zeros((len(x), 2), np.float32)
    ends[first, 0] = ends[last, 1] = 1
    return np.concatenate([x, before, after, ends, np.ones((len(x), 1), np.float32)], 1)


def marginals(unary: np.ndarray, pair: np.ndarray, at: np.ndarray, want_pairs: bool = False):
    """P(good) of each line by forward and backward passes over all texts at once; the expected label pairs if want_pairs.

    unary: the score of good minus that of bad; pair: 2x2 scores of neighbouring labels (0 bad, 1 good).
    """
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    n, start = n[order], at[:-1][order]
    e = np.stack([np.ones(len(unary)), np.exp(np.clip(unary, -30, 30))], 1)
    e /= e.sum(1, keepdims=True)
    t = np.exp(pair - pair.max())
    fwd, bwd = np.zeros((len(unary), 2)), np.ones((len(unary), 2))
    live = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")  # texts of more than so many lines
    for s, k in enumerate(live):
        i = start[:k] + s
        f = e[i] if s == 0 else e[i] * (fwd[i - 1] @ t)
        fwd[i] = f / f.sum(1, keepdims=True)
    for s in range(len(live) - 2, -1, -1):
        i = start[: live[s + 1]] + s
        b = (e[i + 1] * bwd[i + 1]) @ t.T
        bwd[i] = b / b.sum(1, keepdims=True)
    p = fwd * bwd
    p /= p.sum(1, keepdims=True)
    if not want_pairs:
        return p[:, 1]
    inner = np.ones(len(unary), bool)
    inner[at[:-1][np.diff(at) > 0]] = False
    i = np.flatnonzero(inner)
    both = fwd[i - 1][:, :, None] * t[None] * (e[i] * bwd[i])[:, None, :]
    return p[:, 1], (both / both.sum((1, 2), keepdims=True)).sum(0), i


class Field:
    """The fitted field."""

    def __init__(self, weights, pair, mean, scale, curve):
        self.weights, self.pair, self.mean, self.scale, self.curve = weights, pair, mean, scale, curve

    def raw(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Length-weighted marginals; -1 where there are no words."""
        x, size, at = line_numbers(data, bounds)
        out = np.full(len(bounds) - 1, -1.0)
        if len(x):
            p = marginals(with_neighbours((x - self.mean) / self.scale, at) @ self.weights, self.pair, at)
            out = _by_text(p, size, at)
        return out

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        m = self.raw(data, bounds)
        return np.where(m < 0, 0.0, _stretch(m, self.curve))


def _by_text(p: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(size)])
    part = np.concatenate([[0], np.cumsum(size * p)])
    w = total[at[1:]] - total[at[:-1]]
    return np.where(w > 0, np.clip((part[at[1:]] - part[at[:-1]]) / np.maximum(w, 1e-9), 0, 1), -1.0)


def _stretch(m: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    z = np.log(np.clip(m, 1e-4, 1 - 1e-4) / (1 - np.clip(m, 1e-4, 1 - 1e-4)))
    return 1 / (1 + np.exp(-(curve[0] * z + curve[1])))


class Constant:
    """Stands in where there are no labels of both kinds."""

    def __init__(self, share: float):
        self.share = share

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        starts, _, at = common.words_of(data, bounds)
        return np.where(np.diff(at) > 0, self.share, 0.0)


def _adam(grad, shape, steps: int, rate: float):
    w, m, v = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for s in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - s / (steps + 1)) * (m / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.999**s)) + 1e-8)
    return w


def fit_field(x: np.ndarray, size: np.ndarray, at: np.ndarray, label: np.ndarray, steps: int = 250) -> Field:
    """Fit to documents (their lines' numbers, from at[i] to at[i+1]) with labels 0 and 1."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    f = with_neighbours((x - mean) / scale, at).astype(np.float64)
    y = np.repeat(label, np.diff(at)).astype(float)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))  # both labels weigh alike
    k = f.shape[1]

    def grad(w):
        p, pairs, inner = marginals(f @ w[:k], w[k:].reshape(2, 2), at, True)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
        return np.concatenate([f.T @ ((p - y) * weight) / len(y) + 1e-4 * w[:k], ((pairs - seen) / len(y)).ravel() + 1e-2 * w[k:]])

    w = _adam(grad, k + 4, steps, 0.1)
    pair = w[k:].reshape(2, 2)
    m = _by_text(marginals(f @ w[:k], pair, at), size, at)
    z = np.log(np.clip(m, 1e-4, 1 - 1e-4) / (1 - np.clip(m, 1e-4, 1 - 1e-4)))
    balance = np.where(label == 1, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6))

    def slope(c):
        d = (1 / (1 + np.exp(-(c[0] * z + c[1]))) - label) * balance / len(z)
        return np.array([(d * z).sum() + 1e-3 * (c[0] - 1), d.sum()])

    return Field(w[:k], pair, mean, scale, tuple(_adam(slope, 2, 400, 0.05)))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field | Constant:
    """Learn from the labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.min(label_col).alias("l_y")).where(~held_out("l_id"))
    rows = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES)
    crc = F.crc32(F.concat(F.lit("sample"), F.col("l_id").cast("string")).cast("binary"))
    picked = rows.select("d_id").join(known, F.col("d_id") == F.col("l_id")).groupBy("l_id").agg(F.min("l_y").alias("l_y")).orderBy(crc, "l_id").limit(SAMPLE)
    few = docs.sparkSession.createDataFrame(picked.collect(), "l_id long, l_y int")  # SAMPLE rows at most

    def run(batches):
        for batch in batches:
            for i, j, data, bounds in common.pieces(common.text_column(batch, "t")):
                x, size, at = line_numbers(data, bounds)
                rows = [(x[a:b].tobytes(), size[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["id", "y", "x", "size"])

    sample = rows.join(F.broadcast(few), F.col("d_id") == F.col("l_id")).select("d_id", "t", "l_y").mapInArrow(run, "id long, y int, x binary, size binary").collect()
    label = np.array([int(r["y"] == 1) for r in sample])
    if not len(label) or label.min() == label.max():
        return Constant(float(label.mean()) if len(label) else 1.0)
    sample = sorted(sample, key=lambda r: (r["id"], r["x"]))
    label = np.array([int(r["y"] == 1) for r in sample])
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, N) for r in sample]
    at = np.cumsum([0, *map(len, x)])
    if not at[-1]:
        return Constant(float(label.mean()))
    return fit_field(np.concatenate(x), np.concatenate([np.frombuffer(r["size"]) for r in sample]), at, label)


def score(docs: DataFrame, model: Field | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            out = [model.score(data, bounds) for _, _, data, bounds in common.pieces(common.text_column(batch, "t"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good(docs: DataFrame, model: Field | Constant, text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows that score `least` or more, with all their columns."""

    def run(batches):
        for batch in batches:
            out = [model.score(data, bounds) for _, _, data, bounds in common.pieces(common.text_column(batch, text_col))]
            yield batch.filter(pa.array(np.concatenate(out) >= least if out else np.zeros(0, bool)))
        common.release()

    return docs.mapInArrow(run, docs.schema)
