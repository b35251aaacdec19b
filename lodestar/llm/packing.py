"""Best-fit packing of token sequences by a configuration linear program.

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths (at most `capacity` numbers) reaches
the driver. Its configuration LP (minimise sequences; each column a multiset of lengths that fits) is solved by multiplicative
weights: lengths less covered weigh more, a knapsack dynamic program prices the best configuration under the weights, and it
enters with a step that covers its scarcest length. The fractional solution is rounded down at several scales, what is left
is packed best-fit decreasing over the histogram, and the rounding with fewest sequences wins. The plan says which ranks
of each length go to which sequences; its size depends on the capacity alone. Pieces get their rank from counts per
task and length, so no length's pieces meet in one task.

Null texts are empty texts and take one token (the end); equal and null ids stay separate rows; an empty table gives none.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def _knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of most value within the capacity, {length: times}."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            got = best[c - lengths[:n]] + value[:n]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], pick[c] = got[i], i
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            x = int(lengths[pick[c]])
            out[x] = out.get(x, 0) + 1
            c -= x
    return out


def solve_lp(counts: dict[int, int], capacity: int, rounds: int, eta: float = 8.0) -> list[tuple[dict[int, int], float]]:
    """Configurations with fractional times: multiplicative weights on the covering LP."""
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[x] for x in lengths.tolist()], float)
    place = {x: i for i, x in enumerate(lengths.tolist())}
    covered = np.zeros(len(lengths))
    found: dict[tuple, float] = {}
    for _ in range(rounds if len(lengths) else 0):
        open_ = covered < 1
        if not open_.any():
            break
        weight = np.where(open_, np.exp(-eta * covered), 0.0) * lengths  # a full sequence of any mix is worth its tokens
        config = _knapsack(lengths[open_], weight[open_], capacity)
        if not config:
            break
        at = [place[x] for x in config]
        times = np.array(list(config.values()), float)
        step = float((need[at] * np.maximum(1 - covered[at], 0.05) / times).min())
        covered[at] += step * times / need[at]
        key = tuple(sorted(config.items(), reverse=True))
        found[key] = found.get(key, 0.0) + step
    return [(dict(k), x) for k, x in found.items()]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing over a histogram: (configuration, times); equal bins are one entry."""
    bins: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []

    def put(config: tuple, room: int, n: int) -> None:
        if room not in bins:
            bins[room] = {}
            insort(rooms, room)
        bins[room][config] = bins[room].get(config, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                if left >= each:
                    put(((length, each),), capacity - each * length, left // each)
                if left % each:
                    put(((length, left % each),), capacity - left % each * length, 1)
                break
            room = rooms[i]
            config, n = bins[room].popitem()
            if not bins[room]:
                del bins[room], rooms[i]
            each = room // length
            take = min(n, left // each)
            if not take:
                take, each = 1, left
            if n > take:
                put(config, room, n - take)
            put((*config, (length, each)), room - each * length, take)
            left -= take * each
    return [(c, n) for by in bins.values() for c, n in by.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = 600) -> list[tuple[tuple, int]]:
    """(configuration, times) that use up the histogram exactly, in as few sequences as found."""
    whole = [(((capacity, 1),), counts[capacity])] if counts.get(capacity) else []
    counts = {x: n for x, n in counts.items() if n and x < capacity}
    lp = sorted(solve_lp(counts, capacity, rounds), key=lambda c: -sum(x * n for x, n in c[0].items()))
    best, fewest = [], None
    for scale in (1.0, 0.9, 0.7, 0.4, 0.2, 0.1, 0.05):
        left, got = dict(counts), []
        for config, x in lp:
            n = min([int(x * scale), *(left[k] // m for k, m in config.items())])
            if n:
                got.append((tuple(sorted(config.items(), reverse=True)), n))
                for k, m in config.items():
                    left[k] -= n * m
        got += best_fit({x: n for x, n in left.items() if n}, capacity)
        total = sum(n for _, n in got)
        if fewest is None or total < fewest:
            best, fewest = got, total
    return whole + best


def _runs(configs: list[tuple[tuple, int]]) -> np.ndarray:
    """Rows length, first rank, each (per sequence), first sequence, offset; ordered by length and rank."""
    rows, rank, sequence = [], {}, 0
    for config, times in configs:
        offset = 0
        for length, each in config:
            rows.append((length, rank.get(length, 0), each, sequence, offset))
            rank[length] = rank.get(length, 0) + times * each
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of the documents: PIECES, where place counts the pieces of this length before this one in its task, and the ids if with_ids."""

    def run(batches):
        enc, seen = tokens.encoder(vocabulary), np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            doc_ids = batch.column(0)
            for i, j, data, bounds in common.pieces(common.text_column(batch, "t")):
                ids, upto = enc.encode(data, bounds)
                ids = np.insert(ids.astype("<u4"), upto[1:], end_id)
                upto = upto + np.arange(len(upto))
                n = np.diff(upto)
                each = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), each)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                order = np.argsort(length, kind="stable")
                values, first, times = np.unique(length[order], return_index=True, return_counts=True)
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(length)) - np.repeat(first, times) + np.repeat(seen[values], times)
                seen[values] += times
                a = upto[:-1][row] + start
                each_ids = [ids[s:e] for s, e in zip(a.tolist(), (a + length).tolist(), strict=True)]
                cols = [doc_ids.take(pa.array(i + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in each_ids], pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(place)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in each_ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, rounds: int = 600, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if with_ids."""
    spark = docs.sparkSession
    rows = common.stored(cut(docs, capacity, end_id, vocabulary, id_col, text_col, with_ids), "pieces")
    by_task = rows.groupBy("task", "length").count()
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast(_runs(plan(counts, capacity, rounds)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    base = by_task.select(F.col("task").alias("t"), F.col("length").alias("l"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    names = [f.name for f in rows.schema if f.name not in ("task", "place")]

    def place(batches):
        r = runs.value
        key = r[:, 0] << 44 | r[:, 1]
        for batch in batches:
            b = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            length, rank = b["length"].to_numpy(), b["place"].to_numpy() + b["base"].to_numpy()
            x = r[np.searchsorted(key, length << 44 | rank, "right") - 1]
            at = rank - x[:, 1]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(x[:, 3] + at // x[:, 2]), pa.array(x[:, 4] + at % x[:, 2] * length)], [*names, "sequence_id", "offset"])

    joined = rows.join(base, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l"))).drop("t", "l")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names) + ", sequence_id long, offset long"
    return joined.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed token rows (sequence_id, ids) of pack(with_ids=True); a sequence holds at most `capacity` ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
