"""N-gram Jaccard join: which texts' sets of word shingles have a Jaccard similarity of at least num/den, as classes.

1. Each task turns its texts into sets of 64-bit shingle hashes and deals them out by hash range: sorted, delta-coded blocks with
   the text's place in its chunk. Shingles that many texts of a chunk hold travel once per chunk, with a count.
2. A range counts each shingle over all texts (its document frequency) and sends back those that at least two texts hold.
   Others can't be shared: n and a text's shared shingles are enough for exact similarities.
3. Texts with equal sets link; only the one with the smallest id goes on.
4. Token-combination prefixes. Shingles are ordered by frequency, then hash. A text of n shingles may lose at most
   tau = n - ceil(n * num / den) of them in a link. Rare shingles (frequency under `frequent`) index alone; frequent ones are
   dealt by hash into classes, of which pairs are indexed. The prefix is extended until the sum of (count - k + 1) over the
   classes, k = 1 or 2, is over tau: then some class keeps k common shingles. The number of classes hangs on the band
   of n, and a text indexes for two bands, so that linked texts share one. Texts with over tau unshared shingles index nothing.
5. Texts that share an index entry get connected (to the entry's smallest id, never pair by pair) into candidate groups. Each
   text is first compared exactly with the smallest of its entries' heads. Texts that this already connects need no more
   comparisons with each other: only blocks of about BLOCK texts of different classes of a group compute exact intersections.
6. Connected components over all these links and the equal sets are the classes.

Null ids link with nothing and keep a null class; null and empty texts have an empty set and link with nothing; texts under k words
are one shingle; rows that repeat an id count as one text each, and share the id's class; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

#: Words, bytes of text and texts at most in a chunk (a longer text is a chunk of its own).
CHUNK_BYTES, CHUNK_TEXTS = 12 << 20, 60_000
#: Texts of a chunk that hold a shingle from which on it travels once.
HOT = 64
#: Texts in a block at most, about.
BLOCK = 128
MOVED = "r int, chunk string, n int, a binary, b binary, c binary"
_ALL = 0xFFFFFFFF


def _planes(x: np.ndarray) -> bytes:
    """Integers as byte planes: those of high bytes, mostly zeros, compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""


def _unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel() if data else np.zeros(0, dtype)


def _delta(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=U64(0))) if len(x) else b""


def _undelta(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, U64), dtype=U64)


class _Chunk:
    def __init__(self):
        self.ids, self.n, self.tokens, self.fps, self.bytes = [], [], [], [], 0

    def rows(self, name: str, ranges: int):
        """Blocks by range, and the chunk's own row."""
        n = np.array(self.n, np.int64)
        tokens = np.concatenate(self.tokens) if self.tokens else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(n), dtype=np.uint32), n)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        _, first, times = np.unique(tokens, return_index=True, return_counts=True)
        hot = np.repeat(times >= HOT, times)
        own = _planes(owner[hot]) if hot.any() else b"", _delta(tokens[hot])
        t = np.concatenate([tokens[~hot], tokens[first[times >= HOT]]])
        o = np.concatenate([owner[~hot], np.full((times >= HOT).sum(), _ALL, np.uint32)])
        w = np.concatenate([np.ones((~hot).sum(), np.uint32), times[times >= HOT].astype(np.uint32)])
        order = np.argsort(t, kind="stable")
        t, o, w = t[order], o[order], w[order]
        cuts = np.searchsorted(t, (np.arange(1, ranges, dtype=U64) * U64((1 << 64) // ranges)))
        at = np.concatenate([[0], cuts, [len(t)]])
        for r in np.flatnonzero(np.diff(at)).tolist():
            s = slice(at[r], at[r + 1])
            yield r, name, len(self.ids), _delta(t[s]), _planes(o[s]), _planes(w[s])
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        null = np.array([i is None for i in self.ids], bool)
        head = np.concatenate([ids.view(np.uint8), null.view(np.uint8), n.view(np.uint8), np.array(self.fps, U64).reshape(-1).view(np.uint8)]).tobytes()
        yield hash_range(name, ranges), name, -len(self.ids), head, own[0], own[1]


def hash_range(name: str, ranges: int) -> int:
    import zlib

    return zlib.crc32(name.encode()) % ranges


def text_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts laid end to end, sorted within each, and how many each has."""
    starts, ends, upto = common.words_of(data, bounds)
    words = common.segment_hashes(data, starts, ends)
    n = np.diff(upto)
    owner = np.repeat(np.arange(len(n)), n)
    if len(words) >= k:
        sh = common.shingle_hashes(words, k)
        same = owner[: len(sh)] == owner[k - 1 :]
        sh, who = sh[same], owner[: len(same)][same]
    else:
        sh, who = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # the whole sequence is the one shingle
        extra = np.zeros(len(short), U64)
        for i in range(k - 1):
            has = n[short] > i
            extra[has] = common.mix((extra[has] ^ words[upto[short[has]] + i]) * U64(0xC2B2AE3D27D4EB4F) + n[short[has]].astype(U64))
        sh, who = np.concatenate([sh, extra]), np.concatenate([who, short])
    order = np.lexsort((sh, who))
    sh, who = sh[order], who[order]
    keep = np.ones(len(sh), bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (who[1:] != who[:-1])
    sh, who = sh[keep], who[keep]
    return sh, np.bincount(who, minlength=len(n))


def _fingerprints(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two 64-bit values for each set."""
    total = np.zeros((2, len(tokens) + 1), U64)
    np.cumsum(tokens, out=total[0, 1:])
    np.cumsum(common.mix(tokens ^ U64(0x51ED270B0B5D0F4D)), out=total[1, 1:])
    upto = np.concatenate([[0], np.cumsum(n)])
    both = total[:, upto[1:]] - total[:, upto[:-1]]
    return common.mix(both + n.astype(U64)).T


def _deal(k: int, ranges: int):
    def run(batches):
        common.release()
        chunk, serial, task = _Chunk(), 0, TaskContext.get().partitionId()

        def out():
            nonlocal chunk, serial
            rows = list(chunk.rows(f"{task}-{serial}", ranges))
            chunk, serial = _Chunk(), serial + 1
            for i in range(0, len(rows), 64):
                r, c, n, a, b, w = zip(*rows[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(c), pa.array(n, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(w, pa.binary())], ["r", "chunk", "n", "a", "b", "c"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, bounds in common.pieces(common.text_column(batch, "t")):
                if chunk.ids and (chunk.bytes + len(data) > CHUNK_BYTES or len(chunk.ids) + j - i > CHUNK_TEXTS):
                    yield from out()
                tokens, n = text_sets(data, bounds, k)
                chunk.ids += ids[i:j]
                chunk.n += n.tolist()
                chunk.tokens.append(tokens)
                chunk.fps += _fingerprints(tokens, n).tolist()
                chunk.bytes += len(data)
        if chunk.ids:
            yield from out()
        common.release()

    return run


def _count(key, rows):
    """A hash range: shingles that two texts hold go back to their chunks, with their frequency."""
    heads, blocks = rows[rows.n < 0], rows[rows.n > 0]
    found = []
    if len(blocks):
        each = [_undelta(a) for a in blocks.a]
        size = np.array(list(map(len, each)))
        t = np.concatenate(each)
        o = np.concatenate([_unplanes(b, np.uint32) for b in blocks.b])
        w = np.concatenate([_unplanes(c, np.uint32) for c in blocks.c])
        which = np.repeat(np.arange(len(blocks)), size)
        order = np.argsort(t, kind="stable")
        _, first, inverse = np.unique(t[order], return_index=True, return_inverse=True)
        df = np.add.reduceat(w[order].astype(np.int64), first)[inverse]
        back = np.empty(len(t), np.int64)
        back[order] = df
        shared = back >= 2
        names = blocks.chunk.tolist()
        at = np.searchsorted(which, np.arange(len(blocks) + 1))
        for i in range(len(blocks)):
            s = slice(at[i], at[i + 1])
            m = shared[s]
            if m.any():
                found.append((0, names[i], 1, _delta(t[s][m]), _planes(o[s][m]), _planes(np.minimum(back[s][m], _ALL).astype(np.uint32))))
    return pd.concat([heads, pd.DataFrame(found, columns=list(rows.columns))], ignore_index=True) if found else heads


def _regroup(num: int, den: int):
    """A chunk: per text its id, n and fingerprint, and its shared shingles if they may be enough for a link."""

    def run(key, rows):
        head = rows[rows.n < 0].iloc[0]
        m = -int(head.n)
        buf = np.frombuffer(head.a, np.uint8)
        ids, null = buf[: 8 * m].view(np.int64), buf[8 * m : 9 * m].astype(bool)
        n, fp = buf[9 * m : 17 * m].copy().view(np.int64), buf[17 * m :].copy().view(np.int64).reshape(m, 2)
        blocks = rows[rows.n > 0]
        t, o, df = np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        if len(blocks):
            t = np.concatenate([_undelta(a) for a in blocks.a])
            o = np.concatenate([_unplanes(b, np.uint32) for b in blocks.b])
            df = np.concatenate([_unplanes(c, np.uint32) for c in blocks.c])
            hot = o == _ALL
            if hot.any():
                ht, hd = t[hot], df[hot]
                order = np.argsort(ht)
                ht, hd = ht[order], hd[order]
                mine, who = _undelta(head.c), _unplanes(head.b, np.uint32)
                t, o, df = np.concatenate([t[~hot], mine]), np.concatenate([o[~hot], who]), np.concatenate([df[~hot], hd[np.searchsorted(ht, mine)]])
        order = np.lexsort((t, df, o))
        t, o, df = t[order], o[order], df[order]
        at = np.searchsorted(o, np.arange(m + 1))
        tau = n - -(-n * num // den)
        may = (n > 0) & ~null & (n - np.diff(at) <= tau)
        cells = [(t[at[i] : at[i + 1]].tobytes(), df[at[i] : at[i + 1]].tobytes()) if x else (None, None) for i, x in enumerate(may.tolist())]
        return pd.DataFrame({"id": pd.array(np.where(null, 0, ids), "Int64").copy() if not null.any() else pd.array([None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)], "Int64"), "n": n, "fp1": fp[:, 0], "fp2": fp[:, 1], "t": [c[0] for c in cells], "df": [c[1] for c in cells]})

    return run


def band(n: int) -> int:
    """Sizes of linked sets, at similarities of 0.8 or more, are in one band or in neighbours."""
    return int(np.log(n) / np.log(1.25)) if n > 0 else 0


def index_entries(n: int, tokens: np.ndarray, df: np.ndarray, num: int, den: int, frequent: int) -> np.ndarray:
    """Hashes of the index entries of one set, by its shared shingles in order of frequency and hash."""
    tau = n - -(-n * num // den)
    have = n - len(tokens)  # unshared shingles come first and index nothing
    rare = int(np.searchsorted(df, frequent))
    alone = tokens[: max(0, min(rare, tau + 1 - have))]
    have += len(alone)
    out = [common.mix(alone ^ U64(0x243F6A8885A308D3))]
    if have <= tau:
        rest = tokens[rare:]
        b = band(n)
        for x in (b, b + 1):
            classes = max(1, int(1.25**x * (den - num) / den) // 2 + 1)
            cls = (rest % U64(classes)).astype(np.int64)
            order = np.argsort(cls, kind="stable")
            rank = np.empty(len(rest), np.int64)
            _, first, times = np.unique(cls[order], return_index=True, return_counts=True)
            rank[order] = np.arange(len(rest)) - np.repeat(first, times)
            gain = np.cumsum(rank > 0)
            stop = int(np.searchsorted(gain, tau + 1 - have)) + 1  # the first prefix that is enough
            p, c = rest[:stop], cls[:stop]
            order = np.argsort(c, kind="stable")
            p, c = p[order], c[order]
            _, first, times = np.unique(c, return_index=True, return_counts=True)
            for gap in range(1, int(times.max(initial=0))):
                same = np.flatnonzero(c[gap:] == c[:-gap]) if gap < len(c) else np.zeros(0, np.int64)
                lo, hi = np.minimum(p[same], p[same + gap]), np.maximum(p[same], p[same + gap])
                out.append(common.mix(common.mix(lo + U64(x)) ^ hi))
    return np.unique(np.concatenate(out))


def _index(num: int, den: int, frequent: int):
    def run(frames):
        for f in frames:
            ids, keys = [], []
            for i, n, t, df in zip(f.id, f.n, f.t, f.df, strict=True):
                e = index_entries(n, np.frombuffer(t, U64), np.frombuffer(df, np.uint32), num, den, frequent)
                ids.append(np.full(len(e), i, np.int64))
                keys.append(e)
            yield pd.DataFrame({"id": np.concatenate(ids), "key": np.concatenate(keys).view(np.int64)}) if ids else pd.DataFrame({"id": [], "key": []})

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of n places over links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _verify(num: int, den: int):
    """A pair of blocks: texts and the smallest text that they are connected to within it."""

    def run(key, rows):
        rows = rows.sort_values("id", ignore_index=True)
        sets = [np.frombuffer(t, U64) for t in rows.t]
        size = np.array(list(map(len, sets)))
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        n, ids = rows.n.to_numpy(), rows.id.to_numpy()
        shared = np.zeros((len(sets), len(sets)), np.float32)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        step, width = 0, int(column[-1]) + 1 if len(column) else 0
        while step < width:  # columns in strips of bounded size
            s = slice(np.searchsorted(column, step), np.searchsorted(column, step + 4096))
            m = np.zeros((len(sets), min(4096, width - step)), np.float32)
            m[row[s], column[s] - step] = 1
            shared += m @ m.T
            step += 4096
        link = den * shared.astype(np.int64) >= num * (n[:, None] + n[None, :] - shared.astype(np.int64))
        i, j = np.nonzero(np.triu(link, 1))
        root = _roots(len(sets), i, j)
        far = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": ids[far], "b": ids[root[far]]})

    return run


def _to_head(num: int, den: int):
    """The rows (id, n, t) and (h_id, h_n, h_t) that link, as a and b."""

    def run(frames):
        for f in frames:
            a, b, last, head = [], [], None, None
            for i, n, t, h, m, u in zip(f.id, f.n, f.t, f.h_id, f.h_n, f.h_t, strict=True):
                if h != last:
                    last, head = h, np.sort(np.frombuffer(u, U64))
                mine = np.frombuffer(t, U64)
                at = np.minimum(np.searchsorted(head, mine), max(len(head) - 1, 0))
                both = int((head[at] == mine).sum()) if len(head) else 0
                if den * both >= num * (n + m - both):
                    a.append(i)
                    b.append(h)
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _linked_to_heads(kept: DataFrame, near: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of texts to the smallest head of their index entries: one comparison a text, however large the group."""
    one = near.groupBy("a").agg(F.min("b").alias("b"))
    mine = kept.select("id", "n", "t").join(one, F.col("id") == F.col("a")).select("id", "n", "t", "b")
    heads = kept.select(F.col("id").alias("h_id"), F.col("n").alias("h_n"), F.col("t").alias("h_t"))
    return mine.join(heads, F.col("b") == F.col("h_id")).drop("b").mapInPandas(_to_head(num, den), "a long, b long")


def _across(kept: DataFrame, groups: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """Links between texts of a candidate group that no known class (node, component) connects yet.

    A class of BLOCK texts or more fills blocks of its own, smaller ones share blocks. A pair of blocks is compared unless
    both hold the same class; groups of one class need nothing. So many copies near one text cost no comparisons here.
    """
    known = known.select(F.col("node").alias("k_id"), F.col("component").alias("k_c"))
    mine = groups.join(known, F.col("node") == F.col("k_id"), "left").select("node", F.col("component").alias("g"), F.coalesce("k_c", "node").alias("c"))
    per = mine.groupBy("g", "c").agg(F.count("*").alias("m"))
    small = F.col("m") < BLOCK
    whole = per.groupBy(F.col("g").alias("w_g")).agg(F.count("*").alias("classes"), F.sum(F.when(small, F.col("m")).otherwise(0)).alias("rest")).where("classes > 1")
    per = per.join(whole, F.col("g") == F.col("w_g")).select(F.col("g").alias("p_g"), F.col("c").alias("p_c"), "m", "rest")
    deal = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(n / BLOCK))
    dealt = mine.join(per, (F.col("g") == F.col("p_g")) & (F.col("c") == F.col("p_c"))).select(
        "node",
        "g",
        F.when(small, F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("c", F.lit(7)), F.ceil(F.col("rest") / BLOCK)))).otherwise(F.xxhash64("c", deal(F.col("m")))).alias("own"),
        F.when(~small, F.col("c")).alias("pure"),
    )
    dealt = common.stored(dealt, "blocks")
    blocks = dealt.select(F.col("g").alias("b_g"), F.col("own").alias("other"), F.col("pure").alias("b_pure")).distinct()
    pairs = dealt.join(blocks, (F.col("g") == F.col("b_g")) & ~F.coalesce(F.col("pure") == F.col("b_pure"), F.lit(False)))
    pairs = pairs.select(F.col("node").alias("p_id"), "g", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    texts = pairs.join(kept.select("id", "n", "t"), F.col("p_id") == F.col("id")).select("g", "x", "y", "id", "n", "t")
    return texts.groupBy("g", "x", "y").applyInPandas(_verify(num, den), "a long, b long")


def classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, frequent: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links of similarity >= num/den >= 0.8)."""
    if not 80 * den <= 100 * num <= 100 * den:
        raise ValueError("similarities from 0.8 to 1")
    ranges = min(max(256, common.input_bytes(docs) >> 22), 1 << 16)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    moved = texts.mapInArrow(_deal(k, ranges), MOVED)
    counted = moved.groupBy("r").applyInPandas(_count, MOVED)
    sets = common.stored(counted.groupBy("chunk").applyInPandas(_regroup(num, den), "id long, n long, fp1 long, fp2 long, t binary, df binary"), "sets")

    linkable = sets.where("id is not null and n > 0")
    equal = linkable.groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    first = equal.where("copies > 1").select("fp1", "fp2", "rep")
    copies = linkable.select("id", "fp1", "fp2").join(first, ["fp1", "fp2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    one = equal.select(F.col("fp1").alias("f1"), F.col("fp2").alias("f2"), "rep")
    kept = linkable.where("t is not null").join(one, (F.col("fp1") == F.col("f1")) & (F.col("fp2") == F.col("f2")) & (F.col("id") == F.col("rep")), "left_semi")
    kept = common.stored(kept.select("id", "n", "t", "df"), "candidates")

    entries = common.stored(kept.mapInPandas(_index(num, den, frequent), "id long, key long"), "entries")
    heads = entries.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("m")).where("m > 1").select("key", "head")
    near = entries.join(heads, "key").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    groups = common.stored(common.components(near), "groups")
    by_head = common.stored(_linked_to_heads(kept, near, num, den), "head-links")
    links = _across(kept, groups, common.components(by_head), num, den).union(by_head)
    found = common.stored(common.components(links.union(copies)), "classes")
    out = sets.select("id", "n").join(found, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose class has a smaller id; rows with a null id stay. All columns, in their order."""
    found = classes(docs, k, num, den, id_col=id_col, text_col=text_col)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
