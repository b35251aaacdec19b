"""What the operators of this subpackage share: shared folders, word scanning, connected components."""

from __future__ import annotations

import ctypes
import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

U64 = np.uint64

# --------------------------------------------------------------------------- shared storage


def new_folder(spark: SparkSession, name: str) -> str:
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder, in folders by the last columns if `by` names them, and read it again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more: what was made of them is stored itself."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Queries that end in here leave no shuffle files, which else stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def file_system(url: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow file system and the path in it; any URL pyarrow knows, such as file, hdfs or s3."""
    return pafs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df, 0 where it has none; it only sizes partitions, never results."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if n < 1 << 58 else 0


def release() -> None:
    """Give a worker's free memory back to the system: workers outlive tasks, and their freed pages add up on an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def keep_memory() -> None:
    """Let a worker's free memory of up to 64 MB, in arrays of up to 8 MB, stay with it: loops over arrays else fetch their pages anew each time."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc alone has it
    if option:
        option(-3, 8 << 20)  # M_MMAP_THRESHOLD
        option(-1, 64 << 20)  # M_TRIM_THRESHOLD


# --------------------------------------------------------------------------- word scanning

#: Bytes that end a word: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that end a word where only digits, letters and non-ASCII characters count.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = NOT_ALNUM[65:91] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

#: The multilinear word hash: a random factor for each place in a word, times the (lower-cased) byte there plus one, modulo 2**64.
#: Two words agree by chance with a probability under 2**-56, whatever their structure.
_VALUE = LOWER.astype(U64) + U64(1)
_SEED = U64(0x9E3779B97F4A7C15)
_factors = np.zeros(0, U64)


def _factor(n: int) -> np.ndarray:
    """The factors of places 0 .. n-1 at least."""
    global _factors
    if len(_factors) < n:
        _factors = mix(mix(np.arange(1, (1 << max(16, (n - 1).bit_length())) + 1, dtype=U64) * _SEED) ^ U64(20240501))
    return _factors


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, strip: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of data[start:end], without regard to ASCII case; the segments in order and apart.

    Works on strips of about `strip` bytes (one segment at least), so that a very long text takes little more memory than itself.
    """
    out, i = np.zeros(len(starts), U64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + strip, "right")))
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        part = data[starts[i] : ends[j - 1]]
        place = np.arange(len(part))
        place -= np.repeat(s, np.diff(s, append=len(part)))
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(_VALUE[part] * _factor(int(place.max(initial=0)) + 1)[place], out=total[1:])
        out[i:j] = mix(total[e] - total[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def words_of(data: np.ndarray, bounds: np.ndarray, stop: np.ndarray = SPACE):
    """Words of texts laid end to end: starts, ends, and at which word each text begins (len(bounds) values)."""
    sep = stop[data]
    inner = np.ones(len(data) + 1, bool)
    inner[1:] = sep
    begins = ~sep & inner[:-1]
    cut = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[cut] |= ~sep[cut]  # a text begins a word even if the one before has no white space at its end
    starts = np.flatnonzero(begins)
    after = np.ones(len(data) + 1, bool)
    after[:-1] = sep
    after[bounds[(bounds > 0)]] = True  # ... and ends one
    ends = np.flatnonzero(~sep & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as binary without nulls."""
    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    return col.fill_null(b"") if col.null_count else col


def pieces(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes (one text at least): from row, to row, bytes, bounds in the bytes."""
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, by the words' hashes."""
    if len(words) < k:
        return np.zeros(0, U64)
    out = np.zeros(len(words) - k + 1, U64)
    for i in range(k):
        out = (out ^ words[i : len(words) - k + 1 + i]) * U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(29)
    return mix(out)


def int_schema(spark_type: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(spark_type)


# --------------------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for each node of an edge.

    Large-star and small-star rounds over DataFrames, until a round changes nothing: as many as the logarithm of the longest path, squared at
    most. Each joins an edge list, which never grows, with one minimum per node. Minima are combined before rows move; the edges of
    a node that has very many are one key of the joins, which adaptive execution splits over tasks.
    """
    shared_dir(edges.sparkSession)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    last = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        big = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        to_low = big.join(low, F.col("a") == F.col("n"))
        e = to_low.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    star = e.groupBy("a").agg(F.min("b").alias("b"))
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
