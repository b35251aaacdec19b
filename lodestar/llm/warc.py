"""WARC archives: written by tasks, read by byte ranges.

Writing: a page is a gzip member with one record. Among records of equal payloads, of `least` bytes or more, the smallest id has a response
record, the others revisit records that name it and carry no payload. Equal payloads are found by SHA-1, counted before rows move. Digests of
very many rows (more than one in HOT of all, and at least HOT) are at most HOT, so they travel as a broadcast and their rows don't
move for the join; the others are joined by digest. A task writes archives under names of its own attempt; the table of
files that Spark commits says which count, so a repeated or speculative attempt leaves others' alone.

Reading: archives are split into byte ranges. A task looks for gzip magic in its range and takes a place as a record's start only if a member
decodes there to a whole WARC header with the fields it needs; it reads each record that starts inside its range to the
record's end, wherever that is. From then on damage is an error, never a lost record: a truncated or corrupt member, a payload of another
length or digest, bytes between two members, a file of another size than its row says.

Null html is an empty payload; a null id is written as "null" and counts as the largest in its group; of rows that repeat the smallest id
that with the smallest url (null last) is the response; rows equal in id, url and html are the same record, all of one type;
an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive, about, and of a range.
ARCHIVE, SPLIT = 1 << 30, 32 << 20
#: Bytes read at once.
READ = 1 << 20
#: Bytes of a header at most.
HEADER = 1 << 20
#: Digests that travel as a broadcast at most.
HOT = 20_000
_NEEDED = {"WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest", "WARC-Full-Payload-Length", "Content-Length"}
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id, url, payload: bytes, digest: str, copy: bool = False, refers_to=None) -> bytes:
    """A gzip member with a response record, or, of a copy, a revisit record."""
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    name = lambda i: "<urn:page:" + ("null" if i is None else str(i)) + ">"
    body = _HEAD + (b"" if copy else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if copy else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Full-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if copy:
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + c.flush()


def header(head: bytes) -> dict | None:
    """The fields of a whole WARC header, or None if it is none."""
    try:
        first, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
    except ValueError:
        return None
    return fields if first.startswith("WARC/") and fields.keys() >= _NEEDED and fields["Content-Length"].isdigit() else None


def parse(fields: dict, rest: bytes) -> dict:
    """A record by its header's fields and what follows the header."""
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x[10:-1])
    name, length = fields["WARC-Record-ID"], int(fields["Content-Length"])
    if len(rest) != length + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"record {name} is damaged: {len(rest)} bytes for {length}")
    kind = fields["WARC-Type"]
    payload = rest[:length].partition(b"\r\n\r\n")[2] if kind == "response" else None
    size, digest = int(fields["WARC-Full-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and (len(payload) != size or digest32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of {name} is damaged")
    return {"page_id": number(name), "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To"))}


def write(pages: DataFrame, folder: str | None = None, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives; rows: path, bytes."""
    spark = pages.sparkSession
    folder = folder or common.new_folder(spark, "warc")
    fs, root = common.file_system(folder)
    fs.create_dir(root, recursive=True)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), payload.alias("p")).withColumn("d", F.unhex(F.sha1("p")))
    place = F.struct(F.col("i").isNull().alias("no"), F.col("i").alias("i"), F.col("u").isNull().alias("nu"), F.col("u").alias("u"))
    large = rows.where(F.octet_length("p") >= least).select("d", place.alias("f"))
    groups = common.stored(large.groupBy("d").agg(F.min("f").alias("first"), F.count("*").alias("n")).where("n > 1"), "warc-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    many = F.col("n") > max(HOT, total // HOT)  # of total rows, so HOT groups at most
    hot = groups.where(many).select(F.col("d").alias("hd"), F.col("first").alias("hot"))
    rest = groups.where(~many).select(F.col("d").alias("d2"), F.col("first").alias("cold"))
    big = F.octet_length("p") >= least
    joined = rows.join(F.broadcast(hot), (F.col("d") == F.col("hd")) & big, "left")
    # rows whose group is known are dealt by their own hash as text, which no digest of 20 bytes equals
    own = F.encode(F.concat(F.lit("-"), F.hex(F.xxhash64("i", "u"))), "utf-8")
    key = F.when(F.col("hot").isNotNull(), own).otherwise(F.col("d"))
    joined = joined.withColumn("key", key).join(rest, (F.col("key") == F.col("d2")) & big, "left").withColumn("first", F.coalesce("hot", "cold"))
    joined = joined.withColumn("first", F.when(F.col("first") != place, F.col("first")))  # of revisits only

    def run(batches):
        part, attempt, out, serial, size = TaskContext.get().partitionId(), uuid.uuid4().hex, None, 0, 0
        fs, root = common.file_system(folder)
        done = []
        name = lambda: f"part-{part:06d}-{serial:04d}-{attempt}.warc.gz"

        def close():
            out.close()
            done.append((f"{folder}/{name()}", size))

        for batch in batches:
            ids, urls, copies, firsts = (batch.column(c).to_pylist() for c in (0, 1, 4, 5))
            for k, (i, u, copy, first) in enumerate(zip(ids, urls, copies, firsts, strict=True)):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name()}", compression=None)
                raw = record(i, u, batch.column(2)[k].as_py(), digest32(batch.column(3)[k].as_py()), copy, first)
                out.write(raw)
                size += len(raw)
                if size >= ARCHIVE:
                    close()
                    out, size, serial = None, 0, serial + 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], ["path", "bytes"])

    return common.stored(joined.select("i", "u", "p", "d", F.col("first").isNotNull().alias("copy"), F.col("first.i").alias("first")).mapInArrow(run, "path string, bytes long"), "warc-files")


def range_records(file, start: int, stop: int, size: int):
    """Records that start in [start, stop) of a seekable file. Members follow each other without a gap: bytes that are no record are an error."""
    at, base, buf, sure = start, start, b"", start == 0
    while at < stop:
        if at < base or at >= base + len(buf) - len(MAGIC):
            file.seek(at)
            base, buf = at, file.read(min(READ + len(MAGIC), size - at))
        i = buf.find(MAGIC, at - base)
        if sure and i != at - base:
            raise ValueError(f"no record at byte {at}")
        if i < 0 or base + i >= stop:
            if i >= 0 or base + len(buf) >= min(stop + len(MAGIC), size):
                return
            at = base + len(buf) - len(MAGIC) + 1
            continue
        here = base + i
        found = _member(file, here, buf[i:], size)
        if found is None:
            if sure:
                raise ValueError(f"no record at byte {here}")
            at = here + 1
            continue
        record, at = found
        sure = True
        yield record


def _member(file, here: int, have: bytes, size: int):
    """The record whose gzip member starts at a place, and the place after it; None if no WARC header decodes there. Damage after that is an error."""
    d, fields, out, at, data = zlib.decompressobj(31), None, [], here + len(have), have
    head, end = b"", -1
    while not d.eof:
        if not data:  # the member goes on past what has been read
            file.seek(at)
            data = file.read(READ)
            at += len(data)
            if not data:
                if fields is None:
                    return None
                raise ValueError(f"record at byte {here} is cut off")
        try:
            part = d.decompress(data, 4096 if fields is None else 0)
        except zlib.error as e:
            if fields is None:
                return None
            raise ValueError(f"record at byte {here} is damaged: {e}") from None
        data = d.unconsumed_tail
        if fields is not None:
            out.append(part)
            continue
        head += part
        end = head.find(b"\r\n\r\n")
        if not head.startswith(b"WARC/"[: len(head)]) or (end < 0 and len(head) > HEADER):
            return None
        if end >= 0:
            fields = header(head[:end])
            if fields is None:
                return None
            out.append(head[end + 4 :])
    if fields is None:
        return None
    return parse(fields, b"".join(out)), at - len(d.unused_data)


def read(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The archives' records (RECORDS); files has path and bytes."""
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = common.file_system(r["path"])
                with fs.open_input_file(path) as f:
                    if f.size() != r["bytes"]:
                        raise ValueError(f"{r['path']} has {f.size()} bytes, not {r['bytes']}")
                    rows, held = [], 0
                    for x in range_records(f, r["start"], min(r["start"] + split, r["bytes"]), r["bytes"]):
                        rows.append(x)
                        held += len(x["payload"] or b"")
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, ranges.count())
    return ranges.repartition(n, "path", "start").mapInArrow(run, RECORDS)
