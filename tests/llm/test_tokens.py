import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import binfmt, packing, tokens


@pytest.fixture(scope="module")
def library():
    return tokens.encoder().library


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aAbs'.,!- \n\t12é´́—<|>ſK\x1c\x85")), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_ids_are_the_librarys(texts):
    enc = tokens.encoder()
    raw = [x.encode() for x in texts]
    ids, upto = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, x in enumerate(texts):
        assert ids[upto[k] : upto[k + 1]].tolist() == enc.library.encode(x, add_special_tokens=False).ids


def test_memo_starts_anew():
    enc = tokens.Encoder(tokens.vocabulary_path(), most=5)
    for _ in range(3):
        raw = b"a b c d e f g h i j a b"
        ids, _ = enc.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == enc.library.encode(raw.decode(), add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aAzZéßſKİΣσÅﬁ漢가ªǅ")), st.characters(codec="utf-8", categories=["L"])), min_size=1, max_size=12), min_size=1, max_size=1100))
def test_joined_words_have_the_librarys_ids(words):
    enc = tokens.encoder()
    ids, length = enc._words(words)
    want = [e.ids for e in enc.library.encode_batch_fast(words, add_special_tokens=False)]
    assert length.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert enc.closes is not None


def test_words_that_close_twice_go_apart():
    enc = tokens.encoder()
    words = ["a", "İstanbul", "bc"]
    ids, length = enc._words(words)
    want = [e.ids for e in enc.library.encode_batch_fast(words, add_special_tokens=False)]
    assert length.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint64).astype(np.uint32)
    assert (binfmt.unpack_bits(binfmt.pack_bits(ids, bits), bits, 1000) == ids).all()
    assert binfmt.bits_of(2**bits) == bits


def test_files(spark, library, tmp_path):
    docs, data = cases.documents(spark)
    manifest = binfmt.write_ids(docs, f"file://{tmp_path}/ids")
    got = binfmt.read_ids(manifest, with_ids=True).collect()
    want = sorted(((d[0], library.encode(d[1] or "", add_special_tokens=False).ids + [1]) for d in data), key=lambda x: (x[0] is not None, x[0] or 0))
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += len(r["ids"])
    assert sorted(map(tuple, (r["ids"] for r in got))) == sorted(tuple(x) for _, x in want)
    first = binfmt.Reader(manifest.orderBy("part").first()["path"])
    assert first.document(3).tolist() == got[3]["ids"] and first.ids(5, 9).tolist() == sum((r["ids"] for r in got), [])[5:9]


def fewest(lengths, capacity=2048):
    """A lower bound on the sequences: pieces over half a sequence never share one, others fill what those leave."""
    best = 0
    for a in range(1, capacity // 2 + 2):
        big = [x for x in lengths if x > capacity - a]
        half = [x for x in lengths if capacity / 2 < x <= capacity - a]
        small = [x for x in lengths if a <= x <= capacity / 2]
        best = max(best, len(big) + len(half) + max(0, -(-(sum(small) - len(half) * capacity + sum(half)) // capacity)))
    return best


def test_packing(spark, library):
    docs, data = cases.documents(spark)
    packed = packing.pack(docs, with_ids=True)
    rows = packed.collect()
    by = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by.setdefault(r["sequence_id"], []).append(r)
    for part in by.values():
        part.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in part] == [sum(x["length"] for x in part[:i]) for i in range(len(part))]
        assert sum(r["length"] for r in part) <= 2048
    assert len(by) <= fewest([r["length"] for r in rows]) + 1
    want = sorted((d[0] if d[0] is not None else -1, tuple((ids := library.encode(d[1] or "", add_special_tokens=False).ids + [0])[s : s + 2048]), s) for d in data for s in range(0, len(library.encode(d[1] or "", add_special_tokens=False).ids) + 1, 2048))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r["ids"]), r["start"]) for r in rows) == want
    assert sum(len(r["ids"]) for r in packing.sequences(packed).collect()) == sum(r["length"] for r in rows)


def test_empty_tables(spark):
    docs, _ = cases.documents(spark, [])
    assert packing.pack(docs).count() == 0
    assert binfmt.read_ids(binfmt.write_ids(docs)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_all_pieces(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, [101, 60, 101, 30, 101, 51][seed], [50, 500, 5, 2000, 1, 300][seed])
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    got = packing.plan(counts, 100, 200)
    used: dict = {}
    for config, n in got:
        assert n > 0 and sum(x * m for x, m in config) <= 100
        for x, m in config:
            used[x] = used.get(x, 0) + m * n
    assert used == counts
    assert sum(n for _, n in got) <= sum(n for _, n in packing.best_fit(counts, 100)) + 1


def test_structured_words_differ():
    """Thue-Morse words, which any polynomial modulo 2**64 confuses; and ASCII case, which the hash leaves out."""
    from lodestar.llm import common

    a, b = b"a", b"b"
    for _ in range(11):
        a, b = a + b, b + a
    words = [a, b, a.upper(), a + b, b + a, a[:-1], b""]
    at = np.cumsum([0, *map(len, words)])
    h = common.segment_hashes(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:]).tolist()
    assert h[0] == h[2] and len({*h}) == 6
    assert h == common.segment_hashes(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:], strip=10).tolist()


def test_other_vocabularies(library):
    """A file that keeps case and joins other characters: its ids come from the library."""
    import public_tokenizers

    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello hello HELLO", "a 1b2  c", ""]
    raw = [x.encode() for x in texts]
    ids, upto = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)] == [enc.library.encode(x, add_special_tokens=False).ids for x in texts]
    assert tokens.encoder().apart
