"""Benchmark decontamination by a prefix-filtered set join of shingles.

A window is `window` consecutive words of an item (all of an item that has fewer). Its shingles are runs of `shingle` words (the whole
window if shorter). A text holds a window only if it holds all its shingles, so one shingle, the rarest over all
texts, is the necessary prefix. Texts are scanned for these prefix shingles alone; a hit gives the window's place by the shingle's
place in it; it must lie within the text (length and positional bounds), and then all its words are compared.

Items are taken in blocks of bounded size, whose index files lie in the shared folder; every text meets every block, blocks going round
outside runs of about RUN_BYTES of texts, so that a block is loaded once a run. One pass over the texts counts the shingles of all blocks. Words are
compared by 64-bit hashes. Null texts have no words; null items and items without words have no windows; rows that repeat
an id count separately; an empty benchmark hits nothing; other columns are ignored or passed on.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

#: Bytes of item text in a block, about.
BLOCK_BYTES = 8 << 20
#: Bytes of texts that a task holds where there are several blocks, about.
RUN_BYTES = 32 << 20
_TABLE = 1 << 22
_loaded: dict[str, dict] = {}


def _load(url: str) -> dict:
    """A block's arrays; a worker keeps the last one."""
    if url not in _loaded:
        _loaded.clear()  # one block at a time: blocks go round outside the texts
        fs, path = common.file_system(url)
        with fs.open_input_file(path) as f:
            z = np.load(io.BytesIO(f.read()), allow_pickle=False)
            block = {k: z[k] for k in z.files}
        table = np.zeros(_TABLE, bool)
        table[(block["key"] & U64(_TABLE - 1)).astype(np.int64)] = True
        _loaded[url] = block | {"table": table}
    return _loaded[url]


def _save(url: str, **arrays) -> None:
    fs, path = common.file_system(url)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    out = io.BytesIO()
    np.savez(out, **arrays)
    with fs.open_output_stream(path) as f:
        f.write(out.getvalue())


class _Texts:
    """Words of texts laid end to end, and where each begins and ends in the data."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.starts, self.ends, self.upto = common.words_of(data, bounds, common.NOT_ALNUM)
        self.words = common.segment_hashes(data, self.starts, self.ends)
        self.data, self.bounds, self.per_size = data, bounds, {}

    def shingles(self, k: int) -> np.ndarray:
        if k not in self.per_size:
            self.per_size[k] = common.shingle_hashes(self.words, k)
        return self.per_size[k]


def _runs(batches, name: str, several: bool):
    """Runs of batches with their texts in pieces: (batch, [(from row, to row, _Texts)]); a batch a run if there is one block."""
    run, held = [], 0
    for batch in batches:
        col = common.text_column(batch, name)
        run.append((batch, [(i, j, _Texts(data, bounds)) for i, j, data, bounds in common.pieces(col)]))
        held += col.nbytes
        if not several or held >= RUN_BYTES:
            yield run
            run, held = [], 0
    if run:
        yield run


def _found(texts: _Texts, block: dict):
    """Places of the words, and entries of the block, where a key of the block stands."""
    key = block["key"]
    for k in np.unique(block["size"]).tolist():
        h = texts.shingles(k)
        at = np.flatnonzero(block["table"][(h & U64(_TABLE - 1)).astype(np.int64)])
        i = np.searchsorted(key, h[at])
        j = np.searchsorted(key, h[at], "right")
        n = j - i
        some = n > 0
        at, i, n = at[some], i[some], n[some]
        entry = np.repeat(i - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.repeat(at, n)
        right = block["size"][entry] == k
        yield place[right], entry[right]


class Blocks:
    """The benchmark's index, in files of bounded size."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, text_col: str, item_col: str, item_text: str):
        folder = common.new_folder(docs.sparkSession, "benchmark")
        items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where("t is not null and i is not null")
        total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        count = max(1, -(-total // BLOCK_BYTES))
        urls = []
        for b in range(count):
            mine = items.where(F.pmod(F.xxhash64("i"), F.lit(count)) == b).collect()  # a block of bounded size
            if self._shingles(mine, f"{folder}/{b}-all", window, shingle):
                urls.append(f"{folder}/{b}")
        times = self._rarity(docs.select(F.col(text_col).alias("t")), [f"{u}-all" for u in urls]) if urls else None
        for b, url in enumerate(urls):
            self._pick(times.where(F.col("b") == b).select("k", "n").toArrow(), url, window)
        if times is not None:
            common.forget(times)
        self.urls = urls

    @staticmethod
    def _shingles(rows: list, url: str, window: int, shingle: int) -> bool:
        """A block's distinct windows with all their shingles; whether there are any."""
        raw = [r["t"].encode() for r in rows]
        texts = _Texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        seen: dict[bytes, int] = {}
        first, length, member, item = [], [], [], []
        for r, row in enumerate(rows):
            a, b = int(texts.upto[r]), int(texts.upto[r + 1])
            n = min(window, b - a)
            for s in range(a, b - n + 1) if n else ():
                w = seen.setdefault(texts.words[s : s + n].tobytes(), len(seen))
                if w == len(first):
                    first.append(s)
                    length.append(n)
                member.append(w)
                item.append(str(row["i"]))
        if not first:
            return False
        names, number = np.unique(np.array(item), return_inverse=True)  # in the order of strings
        pairs = np.unique(np.stack([np.array(member), number], 1), axis=0)
        first, length = np.array(first), np.array(length)
        size = np.minimum(shingle, length)
        per = length - size + 1
        owner = np.repeat(np.arange(len(first)), per)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        key = np.zeros(len(owner), U64)
        for k in np.unique(size).tolist():
            m = size[owner] == k
            key[m] = texts.shingles(k)[first[owner[m]] + offset[m]]
        order = np.argsort(key, kind="stable")
        at = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        _save(url, key=key[order], size=size[owner][order], owner=owner[order].astype(np.int32), offset=offset[order].astype(np.int16), first=first, length=length, text=texts.words, items_at=at, items=pairs[:, 1], names=names.astype("U"))
        return True

    @staticmethod
    def _rarity(texts: DataFrame, urls: list[str]) -> DataFrame:
        """How often each key k of block b stands in all texts, from one pass over them; as many rows as the blocks have keys at most."""

        def run(batches):
            times: list = [None] * len(urls)
            for run in _runs(batches, "t", len(urls) > 1):
                for b, url in enumerate(urls):
                    block = _load(url)
                    if times[b] is None:
                        times[b] = np.zeros(len(block["key"]), np.int64)
                    for _, parts in run:
                        for _, _, t in parts:
                            for _, entry in _found(t, block):
                                times[b] += np.bincount(entry, minlength=len(times[b]))
            for b, n in enumerate(times):
                at = np.flatnonzero(n) if n is not None else ()
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b, np.int32)), pa.array(at), pa.array(n[at])], ["b", "k", "n"])

        counted = texts.mapInArrow(run, "b int, k long, n long").groupBy("b", "k").agg(F.sum("n").alias("n"))
        return common.stored(counted, "rarity")

    @staticmethod
    def _pick(times: pa.Table, url: str, window: int) -> None:
        """The block's index: of each window its rarest shingle, then that of the first hash and place."""
        block = _load(f"{url}-all")
        count = np.zeros(len(block["key"]), np.int64)
        count[times.column("k").to_numpy()] = times.column("n").to_numpy()
        owner, key, first, length = block["owner"], block["key"], block["first"], block["length"]
        rank = np.lexsort((block["offset"], key, count, owner))
        pick = rank[np.searchsorted(owner[rank], np.arange(len(first)))]
        pick = pick[np.argsort(key[pick], kind="stable")]
        w = owner[pick]
        _save(url, key=key[pick], size=block["size"][pick].astype(np.int16), offset=block["offset"][pick], length=length[w].astype(np.int16), first=first[w].astype(np.int32), text=block["text"], window=w, items_at=block["items_at"], items=block["items"], names=block["names"])


class _Hits:
    """What a piece of texts holds of the benchmark: filled block by block."""

    def __init__(self, texts: _Texts):
        self.texts, self.depth, self.names = texts, np.zeros(len(texts.words) + 1, np.int64), {}

    def add(self, block: dict) -> None:
        words, upto = self.texts.words, self.texts.upto
        for place, e in _found(self.texts, block):
            start = place - block["offset"][e]
            text = np.searchsorted(upto, place, "right") - 1
            fits = (start >= upto[text]) & (start + block["length"][e] <= upto[text + 1])
            start, e, text = start[fits], e[fits], text[fits]
            c = 0
            while len(e) and c < block["length"].max():
                long = block["length"][e] > c
                good = ~long
                good[long] = words[start[long] + c] == block["text"][block["first"][e[long]] + c]
                start, e, text = start[good], e[good], text[good]
                c += 1
            np.add.at(self.depth, start, 1)
            np.add.at(self.depth, start + block["length"][e], -1)
            for t, w in np.unique(np.stack([text, block["window"][e]], 1), axis=0).tolist():
                self.names.setdefault(t, set()).update(block["names"][block["items"][block["items_at"][w] : block["items_at"][w + 1]]].tolist())

    def result(self):
        """Words and hit words of each text, and which words are hit."""
        inside = np.cumsum(self.depth[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(inside)])
        return np.diff(self.texts.upto), total[self.texts.upto[1:]] - total[self.texts.upto[:-1]], inside


def _scanned(batches, name: str, urls: list[str]):
    """(batch, [(from row, to row, _Hits)]) of all batches."""
    for run in _runs(batches, name, len(urls) > 1):
        out = [(batch, [(i, j, _Hits(t)) for i, j, t in parts]) for batch, parts in run]
        for url in urls:
            block = _load(url)
            for _, parts in out:
                for _, _, h in parts:
                    h.add(block)
        yield from out


def _contaminated(n: np.ndarray, hit: np.ndarray, share: int | None) -> np.ndarray:
    return (hit > 0) & (share * hit >= n) if share else hit > 0


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, share: int | None = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items (strings, sorted), items_sha256, contaminated: one in `share` words or more is hit, or any word if share is None."""
    urls = Blocks(docs, benchmark, window, shingle, text_col, item_col, item_text).urls

    def run(batches):
        for batch, parts in _scanned(batches, "t", urls):
            for i, j, h in parts:
                n, hit, _ = h.result()
                items = [sorted(h.names.get(t, ())) for t in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array(_contaminated(n, hit, share))], ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, share: int | None = None, text_col: str = "text", mask: str | None = None, chars_col: str = "n_chars") -> DataFrame:
    """The rows that aren't contaminated (see contamination(); by default those without any hit word), with all their columns.

    With a mask, it stands for the hit passages (runs of hit words) in the texts of the rows that a share leaves, however long they are,
    and chars_col, where there is such a column, is counted anew for them.
    """
    urls = Blocks(docs, benchmark, window, shingle, text_col, "item_id", "text").urls

    def run(batches):
        for batch, parts in _scanned(batches, text_col, urls):
            keep, cut = np.ones(batch.num_rows, bool), {}
            for i, j, h in parts:
                n, hit, inside = h.result()
                keep[i:j] = ~_contaminated(n, hit, share)
                x = h.texts
                for t in np.flatnonzero((hit > 0) & keep[i:j]).tolist() if mask is not None else ():
                    a, b = x.upto[t], x.upto[t + 1]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside[a:b].astype(np.int8), [0]])))
                    out, done = [], x.bounds[t]
                    for first, after in edge.reshape(-1, 2).tolist():
                        out += [x.data[done : x.starts[a + first]].tobytes(), mask.encode()]
                        done = x.ends[a + after - 1]
                    cut[i + t] = b"".join([*out, x.data[done : x.bounds[t + 1]].tobytes()])
            if cut:
                batch = _replaced(batch, cut, text_col, chars_col)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _replaced(batch: pa.RecordBatch, cut: dict[int, bytes], text_col: str, chars_col: str) -> pa.RecordBatch:
    """The batch with other texts in some rows."""
    for name, new in ((text_col, {t: x.decode("utf-8", "replace") for t, x in cut.items()}), (chars_col, None)):
        at = batch.schema.get_field_index(name)
        if at >= 0:
            new = new if new is not None else {t: len(x.decode("utf-8", "replace")) for t, x in cut.items()}
            values = [new.get(t, v) for t, v in enumerate(batch.column(at).to_pylist())]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
    return batch
