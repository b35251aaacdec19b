"""Embedding near-duplicates by product quantisation.

Vectors fall into coarse inverted lists (spherical k-means on a bounded sample), which are cut by a second, shared codebook of residuals where there are
more vectors than LISTS lists of PER_LIST take; what is left is coded by subspace. So lists grow in number with the vectors, not in length,
up to LISTS * LISTS of them. Every vector is a query: it probes the lists nearest to it, more of them the more lists there are (see
probes_of), and gets asymmetric distances to their members by table look-up.

Lists near each other form buckets. Members travel to their bucket as codes, queries to the buckets that they probe with one byte a
component. The look-up distance plus both coding errors is an upper bound of the cosine; where it reaches the threshold, the two vectors are
fetched, to their block of the bucket only, and reranked by exact cosines in double precision. Equal vectors are one entry with a
count. Buckets are dealt to tasks in blocks of bounded size; a task gives link counts and its own connections, never pairs. Two
vectors link if either finds the other, counted once.

The loss is in the lists not probed: `recall` measures it against brute force for a set of queries.

Vectors that are null, zero, empty or hold null or non-finite components, and those without an id, link with nothing; vectors of different
lengths don't link; rows that repeat an id are vectors of their own, told apart by their components: each has its own links and the
component that it reaches; other columns are ignored. Components of any numeric type are taken as doubles (floats as they are).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Vectors in a list, about; lists of a codebook at most; vectors that are fitted to at most; members and queries in a block, about.
PER_LIST, LISTS, SAMPLE, MEMBERS, QUERIES = 300, 4096, 20_000, 4096, 16_384
#: Lists in a bucket, about.
NEAR = 16


def probes_of(lists: int, least: int = 16) -> int:
    """Lists to probe: `least` up to 256 lists, then as the cube root of their number."""
    return min(lists, int(np.ceil(least * max(1.0, lists / 256) ** (1 / 3))))


def _kmeans(x: np.ndarray, k: int, rounds: int, spherical: bool, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        total = np.zeros_like(c, dtype=np.float64)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        has = n > 0
        c[has] = (total[has] / n[has, None]).astype(c.dtype)
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _exact(x) -> np.ndarray:
    """Rows of length one in double precision; largest components come first to 1, so that no square is too large or too small."""
    x = np.array(x, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Coarse centroids, centroids of residuals that cut their lists, codebooks of what is left, and buckets of lists."""

    def __init__(self, sample: np.ndarray, n: int, least: int, width: int = 4):
        x = _exact(sample).astype(np.float32)
        self.coarse = _kmeans(x, int(np.clip(n // PER_LIST, 1, LISTS)), 8, True)
        left = x - self.coarse[_nearest(x, self.coarse)]
        fine = int(np.clip(n // (PER_LIST * LISTS), 1, LISTS))
        self.fine = _kmeans(left, fine, 6, False) if fine > 1 else np.zeros((1, x.shape[1]), np.float32)
        left -= self.fine[_nearest(left, self.fine)]
        self.lists = len(self.coarse) * len(self.fine)
        self.probes = probes_of(self.lists, least)
        self.cuts = np.linspace(0, x.shape[1], max(1, -(-x.shape[1] // width)) + 1).astype(int)
        self.books = [_kmeans(left[:, a:b], 256, 6, False) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        groups = -(-len(self.coarse) // NEAR) if len(self.fine) == 1 else len(self.coarse)
        self.bucket = _nearest(self.coarse, _kmeans(self.coarse, groups, 6, True)) if len(self.fine) == 1 else np.arange(groups)

    def center(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each unit vector, and the lists to probe."""
        own = _nearest(x, self.coarse)
        own = own * len(self.fine) + _nearest(x - self.coarse[own], self.fine)
        if self.probes == self.lists:
            return own, np.tile(np.arange(self.lists), (len(x), 1))
        s = x @ self.coarse.T
        first = min(self.probes, len(self.coarse))
        top = np.argpartition(-s, first - 1, axis=1)[:, :first]
        if len(self.fine) == 1:
            return own, top
        out = np.empty((len(x), self.probes), np.int64)
        for i in range(0, len(x), 256):
            t = top[i : i + 256]
            r = x[i : i + 256, None, :] - self.coarse[t]
            d = (r @ self.fine.T) * 2 - (self.fine * self.fine).sum(1) - (r * r).sum(2)[:, :, None]
            d = d.reshape(len(t), -1)
            best = np.argpartition(-d, self.probes - 1, axis=1)[:, : self.probes]
            out[i : i + 256] = np.take_along_axis(t, best // len(self.fine), 1) * len(self.fine) + best % len(self.fine)
        return own, out

    def code(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they leave out."""
        left = x - self.center(own)
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            codes[:, m] = _nearest(left[:, a:b], book)
            left[:, a:b] -= book[codes[:, m]]
        return codes, np.linalg.norm(left, axis=1)

    def distances(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines of queries with the members of a list."""
        out = np.repeat((q @ self.center(np.array([at]))[0])[:, None], len(codes), 1)
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            out += (q[:, a:b] @ book.T)[:, codes[:, m]]
        return out


def _bytes(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(x)]


def _coded(index: Index, f: pd.DataFrame) -> pd.DataFrame:
    """Per vector: its list and bucket; what it is held as (codes, their error, list); the lists that it probes; by bucket, what it asks with (itself in bytes, scale, error, lists there)."""
    x = _exact(f.x.to_list()).astype(np.float32)
    own, probed = index.near(x)
    codes, error = index.code(x, own)
    scale = np.abs(x).max(1) / 127
    small = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(x - small * scale[:, None], axis=1)
    of = index.bucket[probed // len(index.fine)]
    by = np.argsort(of, axis=1, kind="stable")
    lists, of = np.take_along_axis(probed, by, 1).astype("<i4"), np.take_along_axis(of, by, 1)
    head = np.concatenate([small.view(np.uint8), np.stack([scale, lost], 1).astype("<f4").view(np.uint8)], 1)
    asked, buckets = [], []
    for r, b, h in zip(lists, of, _bytes(head), strict=True):
        at = np.flatnonzero(np.diff(b, prepend=-1))
        buckets.append(b[at])
        asked.append([h + x.tobytes() for x in np.split(r, at[1:])])
    held = np.concatenate([codes, error.astype("<f4").view(np.uint8).reshape(-1, 4), own.astype("<i4").view(np.uint8).reshape(-1, 4)], 1)
    return pd.DataFrame({"k": f.k, "own": own, "bucket": index.bucket[own // len(index.fine)], "held": _bytes(held), "probed": _bytes(probed.astype("<i4")), "buckets": buckets, "asked": asked})


def _wanted(index: Index, block: int, rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """A block of a bucket: the vectors that some bound lets link, as members or as queries."""
    members, queries = rows[~rows["query"]], rows[rows["query"]]
    if not len(members) or not len(queries):
        return pd.DataFrame({"block": [], "query": [], "k": []}).astype({"block": "int64", "query": "bool", "k": "int64"})
    held = np.frombuffer(b"".join(members.code), np.uint8).reshape(len(members), -1)
    codes, error, own = held[:, :-8], held[:, -8:-4].copy().view("<f4").ravel(), held[:, -4:].copy().view("<i4").ravel()
    d = int(index.cuts[-1])
    head = np.frombuffer(b"".join(c[: d + 8] for c in queries.code), np.uint8).reshape(len(queries), -1)
    scale, lost = head[:, d:].copy().view("<f4").T
    q = head[:, :d].copy().view(np.int8) * scale[:, None]
    which = np.frombuffer(b"".join(c[d + 8 :] for c in queries.code), "<i4")
    asks = np.repeat(np.arange(len(q)), [(len(c) - d - 8) // 4 for c in queries.code])
    here = np.isin(which, own)
    asks, which = asks[here], which[here]
    order, mine = np.argsort(which, kind="stable"), np.argsort(own, kind="stable")
    asks, which, sorted_own = asks[order], which[order], own[mine]
    want_q, want_m = np.zeros(len(q), bool), np.zeros(len(own), bool)
    for at in np.unique(which).tolist():
        a = asks[np.searchsorted(which, at) : np.searchsorted(which, at, "right")]
        m = mine[np.searchsorted(sorted_own, at) : np.searchsorted(sorted_own, at, "right")]
        for i in range(0, len(a), 256):
            c = a[i : i + 256]
            may = index.distances(q[c], at, codes[m]) + lost[c][:, None] * (1 + error[m]) + error[m] >= threshold - 1e-4
            may &= queries.k.to_numpy()[c][:, None] != members.k.to_numpy()[m]
            want_q[c] |= may.any(1)
            want_m[m] |= may.any(0)
    k = np.concatenate([members.k.to_numpy()[want_m], queries.k.to_numpy()[want_q]])
    return pd.DataFrame({"block": block, "query": np.arange(len(k)) >= want_m.sum(), "k": k})


def _links(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The vectors of a block that may link: links that its queries find, by exact cosines."""
    rows = rows.sort_values(["query", "k"], ignore_index=True)
    members, queries = rows[~rows["query"]], rows[rows["query"]]
    if not len(members) or not len(queries):
        return pd.DataFrame({"k": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
    x, q = _exact(members.x.to_list()), _exact(queries.x.to_list())
    of = lambda r: (r.own.to_numpy(), np.frombuffer(b"".join(r.probed), np.int32).reshape(len(r), -1))
    (m_own, m_probed), (q_own, q_probed) = of(members), of(queries)
    ids, where = np.unique(np.concatenate([members.k.to_numpy(), queries.k.to_numpy()]), return_inverse=True)
    mi, qi = where[: len(members)], where[len(members) :]
    mm, mq = members.m.to_numpy(), queries.m.to_numpy()
    count, linked, edges = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool), []
    for i in range(0, len(q), 256):
        a, b = np.nonzero(q[i : i + 256] @ x.T >= threshold)
        a += i
        found = (qi[a] != mi[b]) & (q_probed[a] == m_own[b][:, None]).any(1)
        a, b = a[found], b[found]
        np.add.at(count, qi[a], mm[b])
        back = ~(m_probed[b] == q_own[a][:, None]).any(1)  # the member doesn't find the query itself
        np.add.at(count, mi[b[back]], mq[a[back]])
        linked[qi[a]] = linked[mi[b]] = True
        edges.append(np.unique(qi[a].astype(np.int64) * len(ids) + mi[b]))
    pairs = np.concatenate(edges)
    root = _roots(len(ids), pairs // len(ids), pairs % len(ids))
    return pd.DataFrame({"k": ids[linked], "n": count[linked], "root": ids[root[linked]]})


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(a):
        low, before = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _of_length(spark: SparkSession, reps: DataFrame, n: int, threshold: float, probes: int) -> DataFrame:
    """(k, n, root) per block for entries (k, x, m) of one length."""
    sample = [r["x"] for r in reps.orderBy(F.xxhash64("k", F.lit(3))).limit(SAMPLE).select("x").collect()]
    index = spark.sparkContext.broadcast(Index(sample, n, probes))
    coded = common.stored(reps.select("k", "x").mapInPandas(lambda frames: (_coded(index.value, f) for f in frames if len(f)), "k long, own int, bucket int, held binary, probed binary, buckets array<int>, asked array<binary>"), "codes")
    members = coded.select("bucket", F.lit(False).alias("query"), "k", F.col("held").alias("code"))
    queries = coded.select("k", F.explode(F.arrays_zip("buckets", "asked")).alias("a")).select(F.col("a.buckets").alias("bucket"), F.lit(True).alias("query"), "k", F.col("a.asked").alias("code"))
    both = members.union(queries)
    sizes = common.stored(both.groupBy(F.col("bucket").alias("b")).agg(F.greatest(F.lit(1), F.ceil(F.sum((~F.col("query")).cast("int")) / MEMBERS)).cast("int").alias("mb"), F.greatest(F.lit(1), F.ceil(F.sum(F.col("query").cast("int")) / QUERIES)).cast("int").alias("qb")), "buckets")
    dealt = both.join(F.broadcast(sizes), F.col("bucket") == F.col("b"))  # a row for each bucket: LISTS at most
    mine = F.pmod(F.xxhash64("k", F.lit(5)), F.when(F.col("query"), F.col("qb")).otherwise(F.col("mb")))
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("mb")).otherwise(F.col("qb")) - 1)))
    place = lambda m, q: (F.col("bucket").cast("long") * (1 << 25) + m) * (1 << 25) + q
    dealt = dealt.select(F.when(F.col("query"), place(F.col("other"), F.col("mine"))).otherwise(place(F.col("mine"), F.col("other"))).alias("block"), "query", "k", "code")
    wanted = dealt.groupBy("block").applyInPandas(lambda key, rows: _wanted(index.value, int(key[0]), rows, threshold), "block long, query boolean, k long")
    whole = reps.select(F.col("k").alias("r"), "x", "m").join(coded.select(F.col("k").alias("c"), "own", "probed"), F.col("r") == F.col("c")).drop("c")
    fetched = wanted.join(whole, F.col("k") == F.col("r")).drop("r")
    return fetched.groupBy("block").applyInPandas(lambda key, rows: _links(rows, threshold), "k long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, probes: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. probes: lists to probe where there are up to 256 (see probes_of)."""
    spark = vectors.sparkSession
    v = F.col("x")
    kept = dict(vectors.dtypes)[vector_col] in ("array<float>", "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x") if kept else F.col(vector_col).cast("array<double>").alias("x"))
    good = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = rows.withColumn("h1", F.when(good, F.xxhash64("x", F.lit(1)))).withColumn("h2", F.when(good, F.xxhash64(F.lit(2), "x")))
    reps = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min_by("x", "id").alias("x"), F.count("*").alias("m"))
    # ids may be shared, so entries have keys of their own, fixed once they are written
    reps = common.stored(reps.withColumn("k", F.monotonically_increasing_id()), "vectors")
    found = None
    for r in reps.groupBy(F.size("x").alias("d")).count().orderBy("d").collect():  # lengths of vectors, not vectors
        part = _of_length(spark, reps.where(F.size("x") == r["d"]).select("k", "x", "m"), r["count"], threshold, probes)
        found = part if found is None else found.union(part)
    empty = spark.createDataFrame([], "k long, n long, root long")
    found = common.stored(found if found is not None else empty, "vector-links")
    links = found.groupBy(F.col("k").alias("l")).agg(F.sum("n").alias("n"))
    groups = common.components(found.select(F.col("k").alias("a"), F.col("root").alias("b")))
    per = reps.select("h1", "h2", "k", "id", "m").join(links, F.col("k") == F.col("l"), "left").join(groups, F.col("k") == F.col("node"), "left")
    per = common.stored(per.select("h1", "h2", "id", "component", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n")), "vector-classes")
    least = per.where("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("id").alias("least"))
    per = per.join(least, F.col("component") == F.col("c"), "left").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "n", F.coalesce("least", "id").alias("c"))
    out = rows.select("id", "h1", "h2").join(per, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def brute_links(vectors: DataFrame, threshold: float = 0.9, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links) by brute force for the rows whose id is divisible by `every`: blocks of queries against all rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull()))
    queries = rows.where(F.col("id") % every == 0)
    count, out = queries.count(), None
    blocks = max(1, -(-count // 5000))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()  # a block of the query set
        if not len(part):
            continue
        held = spark.sparkContext.broadcast((part.id.to_numpy(), np.stack(part.x.to_list()).astype(np.float64)))

        def run(frames, held=held):
            ids, q = held.value
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
            for f in frames:
                if len(f):
                    x = np.stack(f.x.to_list()).astype(np.float64)
                    hit = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T >= threshold
                    yield pd.DataFrame({"vec_id": ids, "n": hit.sum(1) - (ids[:, None] == f.id.to_numpy()[None, :]).sum(1)})

        found = rows.mapInPandas(run, "vec_id long, n long")
        out = found if out is None else out.union(found)
    return out.groupBy("vec_id").agg(F.sum("n").alias("n_links")) if out is not None else spark.createDataFrame([], "vec_id long, n_links long")


def recall(vectors: DataFrame, found: DataFrame, threshold: float = 0.9) -> float:
    """Share of brute-force links of the query set that near_duplicates() has."""
    want = brute_links(vectors, threshold)
    both = want.join(found.select(F.col("vec_id").alias("v"), F.col("n_links").alias("got")), F.col("vec_id") == F.col("v"))
    r = both.agg(F.sum(F.least("n_links", "got")).alias("a"), F.sum("n_links").alias("b")).first()
    return 1.0 if not r["b"] else r["a"] / r["b"]
