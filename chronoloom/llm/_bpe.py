"""Byte-level BPE over whole columns, by the tokenizers library.

Texts split into the vocabulary's pre-tokens with array operations; each distinct pre-token goes through
the library's merge model once per worker and is then served from a bounded cache. Ids equal
Tokenizer.encode(text, add_special_tokens=False). A text that holds one of the vocabulary's special
strings, and any tokenizer that is not plain byte-level BPE, goes through the library as a whole.
"""

from __future__ import annotations

import numpy as np

from ._text import _power_tables, chunks, mix64

_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = 1, 2, 3, 4, 0
#: Distinct pre-tokens kept per worker (about 25 bytes each); beyond that the cache starts anew.
CACHE = 1_500_000

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes every byte as a visible character: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(0x100 + i) for i, b in enumerate(hidden)}}


class Encoder:
    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        model = spec["model"]
        self.plain = (
            spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)
            and model["type"] == "BPE" and not model.get("dropout")
        )
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.letters = _byte_letters()
        self.classes = np.zeros(0x110000, np.uint8)
        self._reset()

    def _reset(self) -> None:
        empty = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.main, self.recent = empty, empty
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def _classify(self, cp: np.ndarray) -> np.ndarray:
        """Character classes, learnt from the library itself, 256 code points at a time."""
        c = self.classes[cp]
        if (c == _UNKNOWN).any():
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for block in np.unique(cp[c == _UNKNOWN] >> 8).tolist():
                for x in range(block << 8, (block + 1) << 8):
                    if not 0xD800 <= x < 0xE000:
                        ch = chr(x)
                        self.classes[x] = next((k for k, probe in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(split(probe + ch)) == 1), _SPACE)
            c = self.classes[cp]
        return c

    def _starts(self, cp: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin. rows: first code point of every non-empty row."""
        n, c = len(cp), self._classify(cp)
        head = np.zeros(n + 1, bool)
        head[rows] = True
        head[n] = True
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(c[1:], c[:-1], out=new[1:])
        new |= head[:n]
        # The last character of a white-space run before a word stands alone, or is the word's own leading blank.
        space = c == _SPACE
        end = space & np.append(new[1:], True) & ~head[1:]  # last of a run, with something after it in its row
        last = np.flatnonzero(end)
        new[last] = True
        joined = last[cp[last] == 0x20]
        new[joined + 1] = False
        # Contractions: an apostrophe that begins a pre-token takes its letters along.
        marks = np.flatnonzero(new[:-1] & (cp[:-1] == 0x27) & (c[1:] == _LETTER) & ~head[1:n]) if n > 1 else []
        for i in marks:
            a = chr(cp[i + 1])
            b = chr(cp[i + 2]) if i + 2 < n and not head[i + 2] else ""
            size = 2 if a in "stmd" else 3 if a + b in ("re", "ve", "ll") else 0
            if size:
                new[i + 1 : i + size] = False
                if i + size < n:
                    new[i + size] = True
        return np.flatnonzero(new)

    def _lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = np.zeros(len(keys), bool)
        off, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for known, o, z in (self.main, self.recent):
            if len(known):
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                hit = known[at] == keys
                off[hit], size[hit] = o[at[hit]], z[at[hit]]
                found |= hit
        return found, off, size

    def _learn(self, keys: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        merge, letters = self.tokenizer.model.tokenize, self.letters
        ids = [[t.id for t in merge(w.encode().decode("latin-1").translate(letters))] for w in words]
        size = np.array([len(x) for x in ids], np.int64)
        off = self.used + np.cumsum(size) - size
        total = int(size.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.empty(max(len(self.pool), total), np.uint32)))
        self.pool[self.used : self.used + total] = [i for x in ids for i in x]
        self.used += total

        def merged(a, b):
            k = np.concatenate((a[0], b[0]))
            order = np.argsort(k)
            return k[order], np.concatenate((a[1], b[1]))[order], np.concatenate((a[2], b[2]))[order]

        self.recent = merged(self.recent, (keys, off, size))
        if len(self.recent[0]) > max(50_000, len(self.main[0]) // 4):
            self.main, self.recent = merged(self.main, self.recent), (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        return off, size

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = int(offsets[0])
        b = raw[base : int(offsets[-1])]
        rel = offsets - base
        if not len(b):
            return np.empty(0, np.uint32), np.zeros(len(rel), np.int64)
        cp = np.frombuffer(b.tobytes().decode().encode("utf-32-le"), np.uint32)
        if len(cp) != len(b):
            lead = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
            rel = lead[rel]
        s = self._starts(cp, rel[:-1][rel[1:] > rel[:-1]])
        e = np.append(s[1:], len(cp))
        fwd, inv = _power_tables(len(cp) + 1)
        value = (cp + np.uint64(1)) * fwd[: len(cp)]
        total = np.cumsum(value, dtype=np.uint64)
        key = mix64((total[e - 1] - total[s] + value[s]) * inv[s])
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.main[0]) + len(self.recent[0]) > CACHE:
            self._reset()
        found, off, size = self._lookup(distinct)
        if not found.all():
            new = np.flatnonzero(~found)
            at = first[new]
            text = [cp[a:z].tobytes().decode("utf-32-le") for a, z in zip(s[at].tolist(), e[at].tolist())]
            off[new], size[new] = self._learn(distinct[new], text)
        size_t, off_t = size[back], off[back]
        ends = np.cumsum(size_t)
        ids = self.pool[np.repeat(off_t - (ends - size_t), size_t) + np.arange(int(ends[-1]))]
        return ids, np.concatenate(([0], ends))[np.searchsorted(s, rel)]

    def encode(self, raw: np.ndarray, offsets: np.ndarray):
        """Yields (row, ids) blocks: for a range of rows their ids and the ids' row offsets, in order."""
        for a, z in chunks(offsets):
            text = raw[int(offsets[a]) : int(offsets[z])].tobytes()
            if self.plain and not any(x in text for x in self.special):
                yield (a, z, *self._plain(raw, offsets[a : z + 1]))
                continue
            for i in range(a, z):
                one = raw[int(offsets[i]) : int(offsets[i + 1])]
                if self.plain and not any(x in one.tobytes() for x in self.special):
                    yield (i, i + 1, *self._plain(raw, offsets[i : i + 2]))
                else:
                    ids = np.array(self.tokenizer.encode(one.tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                    yield i, i + 1, ids, np.array([0, len(ids)])
