"""Token ids by the tokenizers library, memoised by the pieces that it can't join.

The library's own speed is under 1 MB a second and core on invented words. Its pre-tokeniser never joins characters over
white space, nor an ASCII letter, digit or punctuation mark (the apostrophe apart) with a neighbour of another of these
classes, so a text's ids are those of such pieces, end to end. A worker keeps the ids of the pieces that it has seen (up to
a bound, then it starts anew) under 64-bit hashes. Texts that spell out a special token go to the library whole, and so do all texts
where a vocabulary file normalises or splits otherwise (NORMALIZERS, SPLIT).
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import SPACE, U64, segment_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
VOCABULARY = "word_bpe_49k.json"
_CLASS = np.zeros(256, np.uint8)  # 0: never split here
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[39] = 0
#: What the memo is right for: text in lower case, split by this expression (fixed values of the vocabulary file).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_open: dict[str, "Encoder"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None = None) -> "Encoder":
    """This worker's encoder for a vocabulary file."""
    path = path or vocabulary_path()
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


class Encoder:
    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most = most
        with open(path) as f:
            spec = json.load(f)
        split = (((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern") or {}).get("Regex")
        self.apart = (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and split == SPLIT
        model = spec.get("model") or {}
        suffix, vocabulary = model.get("end_of_word_suffix"), self.library.get_vocab(with_added_tokens=False)
        #: Which ids end a word; None unless each byte has such an id, so that every word has one, its last.
        self.closes = None
        if suffix and model.get("type") == "BPE" and sum(t.endswith(suffix) and len(t) == len(suffix) + 1 for t in vocabulary) == 256:
            self.closes = np.zeros(self.library.get_vocab_size(), bool)
            self.closes[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.slots = 1 << 21
        self.key = np.zeros(self.slots, U64)  # by the hash's low bits: one hash
        self.entry = np.full(self.slots, -1, np.int32)
        self.beside: dict[int, int] = {}  # hashes whose place was taken
        self.where = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16 if self.library.get_vocab_size() <= 65536 else np.uint32)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, end to end, and how many each has."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), self.ids.dtype, int(length.sum())), length

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts of letters alone: as one text, which costs half, if its ids show that each is one word."""
        if self.closes is not None:
            lines = [" ".join(texts[i : i + 512]) for i in range(0, len(texts), 512)]
            ids = np.concatenate([np.array(e.ids, self.ids.dtype) for e in self.library.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(texts):
                return ids, np.diff(ends, prepend=0)
        return self._each(texts)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> np.ndarray:
        """Entries of new distinct pieces, words first."""
        word = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        order = np.argsort(~word, kind="stable")
        parts = [f([texts[i] for i in some.tolist()]) for f, some in ((self._words, order[: word.sum()]), (self._each, order[word.sum() :])) if len(some)]
        new, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        hashes = hashes[order]
        entry = np.arange(len(self.length), len(self.length) + len(hashes), dtype=np.int32)
        self.where = np.concatenate([self.where, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, new])
        slot = (hashes & U64(self.slots - 1)).astype(np.int64)
        free = self.entry[slot] < 0
        self.key[slot[free]], self.entry[slot[free]] = hashes[free], entry[free]
        lost = self.key[slot] != hashes
        self.beside.update(zip(hashes[lost].tolist(), entry[lost].tolist(), strict=True))
        out = np.empty_like(entry)
        out[order] = entry
        return out

    def _entries(self, h: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        slot = (h & U64(self.slots - 1)).astype(np.int64)
        out = self.entry[slot]
        out[self.key[slot] != h] = -1
        rest = np.flatnonzero(out < 0)
        if len(rest):
            keys, first, inverse = np.unique(h[rest], return_index=True, return_inverse=True)
            got = np.fromiter((self.beside.get(k, -1) for k in keys.tolist()), np.int32, len(keys))
            new = np.flatnonzero(got < 0)
            if len(new):
                if len(self.length) + len(new) > self.most and len(self.length):
                    self.clear()
                    return self._entries(h, raw, starts, ends)
                i = rest[first[new]]
                got[new] = self._learn(keys[new], [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[i].tolist(), ends[i].tolist(), strict=True)])
            out[rest] = got[inverse]
        return out

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts laid end to end, and the bounds of each text's ids (add_special_tokens=False)."""
        raw = data.tobytes()
        if not self.apart or any(s in raw for s in self.special):
            return self._whole(raw, bounds)
        if not len(data):
            return self.ids[:0], np.zeros(len(bounds), np.int64)
        sep, kind = SPACE[data], _CLASS[data]
        begins = np.ones(len(data) + 1, bool)
        a, b = kind[:-1], kind[1:]
        begins[1:-1] = sep[:-1] | ((a != 0) & (b != 0) & ((a != b) | (b == 2)))
        begins[bounds] = True
        starts = np.flatnonzero(begins[:-1] & ~sep)
        ends_at = begins[1:].copy()
        ends_at[:-1] |= sep[1:]
        ends = np.flatnonzero(ends_at & ~sep) + 1
        h = segment_hashes(data, starts, ends)
        at = self._entries(h, raw, starts, ends)
        length = self.length[at]
        upto = np.zeros(len(at) + 1, np.int64)
        np.cumsum(length, out=upto[1:])
        ids = self.ids[np.repeat(self.where[at] - upto[:-1], length) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, bounds)]

    def _whole(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        upto = np.zeros(len(bounds), np.int64)
        np.cumsum([len(x) for x in found], out=upto[1:])
        return np.fromiter((i for x in found for i in x), self.ids.dtype, int(upto[-1])), upto
