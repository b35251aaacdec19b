"""Secret scans: an Aho-Corasick automaton finds keywords, anchored expressions run at its hits only, checksums are validated.

Kinds: assign (a name such as password or api_key, a colon or equals sign, and a value of 8 characters or more), access (AKIA and so
on, 16 or more), hex (runs of 32 or more hexadecimal digits, found by their byte classes), and as additions of the method
github and npm (tokens whose last six base-62 digits are the CRC-32 of the thirty before them). Matches of a kind are leftmost
and don't overlap; one too short is dropped but has used up its text. Spans count code points, ends are exclusive.

Null texts are empty texts; rows that repeat an id count separately; other columns are ignored or passed on.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "github", "npm")
_WORDS = {**dict.fromkeys(("password", "passwd", "secret", "token", "api_key", "apikey"), "assign"), "akia": "access", **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"), "npm_": "npm"}
_AT = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
}
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_NOT_HEX = np.ones(256, bool)
_NOT_HEX[48:58] = _NOT_HEX[97:103] = False
_automaton = None


def base62(n: int, width: int = 6) -> bytes:
    out = b""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS[r : r + 1] + out
    return out.rjust(width, b"0")


def _holds(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    return base62(zlib.crc32(m[1])) == m[2]


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for w, kind in _WORDS.items():
            _automaton.add_word(w, (len(w), kind))
        _automaton.make_automaton()
    return _automaton


def spans(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, kind, end) in bytes of the data, sorted, of texts laid end to end."""
    raw = data.tobytes()
    hits = sorted((end - n + 1, kind) for end, (n, kind) in _keywords().iter(raw.translate(common.LOWER_BYTES).decode("latin-1")))
    out, upto = [], dict.fromkeys(KINDS, 0)
    texts = (np.searchsorted(bounds, [h[0] for h in hits], "right") - 1).tolist() if hits else []
    for (at, kind), t in zip(hits, texts, strict=True):
        if at >= upto[kind] and (m := _AT[kind].match(raw, at, int(bounds[t + 1]))):
            upto[kind] = m.end()
            if _holds(kind, m):
                out.append((t, at, KINDS.index(kind), m.end()))
    starts, ends, _ = common.words_of(data, bounds, _NOT_HEX)
    long = ends - starts >= 32
    if long.any():
        s, e = starts[long], ends[long]
        out += zip((np.searchsorted(bounds, s, "right") - 1).tolist(), s.tolist(), [2] * len(s), e.tolist(), strict=True)
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and its spans, an array of (kind, start, end)."""

    def run(batches):
        for batch in batches:
            for i, j, data, bounds in common.pieces(common.text_column(batch, "t")):
                found = spans(data, bounds)
                rows: list[list] = [[] for _ in range(j - i)]
                if found:
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for t, s, kind, e in found:
                        rows[t].append({"kind": KINDS[kind], "start": int(chars[s] - chars[bounds[t]]), "end": int(chars[e] - chars[bounds[t]])})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """scan()'s rows as counts, a hash of the base kinds, and one string."""
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text("found").alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mask: str = "[secret]") -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by the mask, and n_chars, where there is such a column, counted anew."""
    put = mask.encode()

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            kind = batch.column(at).type
            texts = None
            for i, _, data, bounds in common.pieces(common.text_column(batch, text_col)):
                found = spans(data, bounds)
                if not found:
                    continue
                texts = texts or batch.column(at).cast(pa.large_binary()).to_pylist()
                by: dict[int, list] = {}
                for t, s, _, e in found:
                    by.setdefault(t, []).append((s - int(bounds[t]), e - int(bounds[t])))
                for t, cuts in by.items():
                    raw, out, upto, masked = texts[i + t], [], 0, -1
                    for s, e in sorted(cuts):
                        if s >= masked:
                            out += [raw[upto:s], put]
                        masked = upto = max(upto, e)
                    texts[i + t] = b"".join([*out, raw[upto:]])
            if texts is not None:
                text = pa.array(texts, pa.large_binary()).cast(pa.large_string())
                batch = batch.set_column(at, batch.schema.field(at), text.cast(kind))
                n = batch.schema.get_field_index(chars_col)
                if n >= 0:
                    import pyarrow.compute as pc

                    batch = batch.set_column(n, batch.schema.field(n), pc.utf8_length(text).cast(batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
