"""Token-id files: fixed-width bit packing with block offsets.

File: magic, packed blocks of BLOCK ids each (the last may be shorter), then a footer of int64 values (document ids, whether
each is null, token counts, block offsets), then a trailer (footer offset, documents, blocks, ids, bits per id, magic). An id
takes the minimum bits of the vocabulary, lowest bit first, so any block, and any range of ids in it, unpacks with numpy alone.

`write_ids` range-partitions documents by id and writes a file per partition; a manifest (path, counts, ids before it) joins
them. A task writes under a name of its own attempt, and the manifest, which Spark commits, says which files count, so repeated or
speculative attempts leave others' files alone. Null texts are
empty texts; null ids come first; equal ids stay separate rows, ordered by text; an empty table has no files. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC, TRAILER, BLOCK = b"LTOKv1\0\0", struct.Struct("<5q8s"), 1 << 13
MANIFEST = "part int, path string, n_docs long, n_tokens long"


def bits_of(vocabulary: int) -> int:
    """Bits that hold ids 0 .. vocabulary-1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    """Appends documents' ids to one file; holds one block and the index."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        self.rest, self.n_rest, self.docs, self.nulls, self.counts, self.blocks = [], 0, [], [], [], []
        out.write(MAGIC)

    def add(self, ids: np.ndarray, doc_ids: list, counts: np.ndarray) -> None:
        """ids of several documents, end to end."""
        self.docs += [0 if d is None else d for d in doc_ids]
        self.nulls += [d is None for d in doc_ids]
        self.counts += counts.tolist()
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= BLOCK:
            ids = np.concatenate(self.rest)
            whole = len(ids) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(ids[i : i + BLOCK])
            self.rest, self.n_rest = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.blocks.append(self.at)
        self.at += self.out.write(data) or len(data)

    def close(self) -> tuple[int, int]:
        if self.n_rest:
            self._block(np.concatenate(self.rest))
        n = sum(self.counts)
        self.out.write(np.array([*self.docs, *self.nulls, *self.counts, *self.blocks], "<i8").tobytes())
        self.out.write(TRAILER.pack(self.at, len(self.docs), len(self.blocks), n, self.bits, MAGIC))
        self.out.close()
        return len(self.docs), n


class Reader:
    """Random access to one file."""

    def __init__(self, url: str):
        fs, path = common.file_system(url)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - TRAILER.size)
        self.end, docs, blocks, self.n, self.bits, magic = TRAILER.unpack(self.file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token-id file: {url}")
        self.file.seek(self.end)
        index = np.frombuffer(self.file.read((3 * docs + blocks) * 8), "<i8")
        self.doc_ids = [None if null else d for d, null in zip(index[:docs].tolist(), index[docs : 2 * docs].tolist(), strict=True)]
        self.upto = np.concatenate([[0], np.cumsum(index[2 * docs : 3 * docs])])
        self.offsets = np.append(index[3 * docs :], self.end)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop-1 of the file, by the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (stop - 1) // BLOCK
        self.file.seek(int(self.offsets[a]))
        data = self.file.read(int(self.offsets[b + 1] - self.offsets[a]))
        width = BLOCK * self.bits // 8
        parts = [unpack_bits(data[(i - a) * width : (i - a + 1) * width], self.bits, min(BLOCK, self.n - i * BLOCK)) for i in range(a, b + 1)]
        return np.concatenate(parts)[start - a * BLOCK : stop - a * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.upto[i]), int(self.upto[i + 1]))


def write_ids(docs: DataFrame, folder: str | None = None, end_id: int = 1, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write documents' ids, each with end_id after it, in ascending order of ids; the manifest comes back.

    Manifest rows: part, path, n_docs, n_tokens, base (ids in the files before this one).
    """
    spark = docs.sparkSession
    folder = folder or common.new_folder(spark, "token-ids")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.input_bytes(docs) >> 26)
    fs, root = common.file_system(folder)
    fs.create_dir(root, recursive=True)

    def write(batches):
        enc = tokens.encoder(vocabulary)
        bits = bits_of(enc.library.get_vocab_size())
        part = TaskContext.get().partitionId()
        fs, root = common.file_system(folder)
        name, writer = f"part-{part:06d}-{uuid.uuid4().hex}.ids", None
        for batch in batches:
            ids_col = batch.column(0).to_pylist()
            for i, j, data, bounds in common.pieces(common.text_column(batch, "t")):
                ids, upto = enc.encode(data, bounds)
                ids = np.insert(ids.astype(np.uint32), upto[1:], end_id)
                writer = writer or Writer(fs.open_output_stream(f"{root}/{name}"), bits)
                writer.add(ids, ids_col[i:j], np.diff(upto) + 1)
        if writer:
            n_docs, n = writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name}", "n_docs": n_docs, "n_tokens": n}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).repartitionByRange(parts, "i").sortWithinPartitions("i", "t")
    manifest = common.stored(rows.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and the ids if with_ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                r = Reader(row["path"])
                step = max(1, len(r.doc_ids) // max(1, r.n >> 21))
                for a in range(0, len(r.doc_ids), step):
                    b = min(a + step, len(r.doc_ids))
                    ids, at = r.ids(int(r.upto[a]), int(r.upto[b])), r.upto[a : b + 1] - r.upto[a]
                    each = [ids[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    cols = [pa.array(r.doc_ids[a:b], pa.int64()), pa.array(r.upto[a:b] + row["base"], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    files = max(1, manifest.count())
    return manifest.repartition(files, "part").mapInArrow(read, schema)
