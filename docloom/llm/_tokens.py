"""Encoding with the ``tokenizers`` library, one distinct piece of text at a time.

Both encoders cut texts where the tokenizer's own pre-tokenizer always cuts, encode each distinct piece of a
step once, in batches, and keep it in a cache of bounded size. What lies between two cuts is encoded by the
library alone. Pieces count as equal if a 64-bit hash of their bytes and their length agrees.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa

from docloom.llm._text import span_hashes, span_strings, text_bytes

#: Entries of one generation of a cache; two generations are held.
CACHE_ENTRIES = 100_000
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 4 << 20

#: Letters that are stable under NFC and whose lower case is one letter of the same kind.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Marks that neither join a letter nor begin a contraction or a special token.
_MARKS = r"[,.;:!?*$%&#)\]]"


class Cache(dict):
    """A dict of the values in use, and those of the generation before."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.entries, self.old = entries, {}

    def missing(self, keys) -> list:
        """Those of ``keys`` that no generation has; the others are there afterwards."""
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()
        out = []
        for k in keys:
            if k not in self:
                v = self.old.get(k)
                if v is None:
                    out.append(k)
                else:
                    self[k] = v
        return out


class HashCache:
    """For each of many pieces, known by hash, a number and a run of ids. Beyond ``limit`` the half used last stays."""

    def __init__(self, limit: int = 2 * CACHE_ENTRIES):
        self.limit, self.tick = limit, 0
        self.keys, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.begin, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _keep(self, at: np.ndarray) -> None:
        self.keys, self.used, self.size, self.begin = self.keys[at], self.used[at], self.size[at], self.begin[at]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Which of ascending ``hashes`` are missing; those found count as used."""
        self.tick += 1
        if len(self.keys) > self.limit:
            self._keep(np.sort(np.argpartition(self.used, -self.limit // 2)[-self.limit // 2 :]))
            if len(self.flat):
                to = np.append(0, np.cumsum(self.size))
                self.flat = self.flat[np.arange(to[-1]) + np.repeat(self.begin - to[:-1], self.size)]
                self.begin = to[:-1]
        at = self.at(hashes)
        found = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.keys)
        found[inside] = self.keys[at[inside]] == hashes[inside]
        self.used[at[found]] = self.tick
        return np.flatnonzero(~found)

    def add(self, hashes: np.ndarray, size: np.ndarray, flat: np.ndarray | None = None) -> None:
        if flat is not None:
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.flat = np.concatenate([self.flat, flat])
        else:
            self.begin = np.concatenate([self.begin, size])
        self.keys = np.concatenate([self.keys, hashes])
        self.size = np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.full(len(hashes), self.tick)])
        self._keep(np.argsort(self.keys, kind="stable"))

    def at(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, hashes)


def _groups(items: list[str], size: int = 256) -> list[list[str]]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of the spans, where each stands first, and which of them each span is."""
    return np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)


class LengthEncoder:
    """Numbers of tokens of a byte-level BPE whose pre-tokenizer keeps one space before a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.begins_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins_word[[i for t, i in vocabulary.items() if t[0] == "Ġ"]] = True  # how the library writes a space
        self.whole, self.parts = HashCache(), Cache()
        self.known = re.compile(rf"( ?[{_LATIN}]+)({_MARKS}*)(?:(\n)([{_LATIN}]+)({_MARKS}*))?")
        # Beside a cut stand printing ASCII characters, or Latin letters whose first byte is C3: never white space.
        self.prints = np.zeros(256, dtype=bool)
        self.prints[0x21:0x7F] = True

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill_parts(self, parts: set[str]) -> None:
        new = self.parts.missing(parts)
        words = [x for x in new if x[0] == " " and x[1:].isalpha()]
        for group, enc in zip(g := _groups(words), self.tokenizer.encode_batch_fast(["".join(x) for x in g], add_special_tokens=False), strict=True):
            begins = np.flatnonzero(self.begins_word[enc.ids])
            counts = np.diff(begins, append=len(enc)).tolist()
            self.parts.update(zip(group, counts if len(counts) == len(group) else self._encode(group), strict=True))
        rest = [x for x in new if x not in self.parts]
        self.parts.update(zip(rest, self._encode(rest), strict=True))

    def _lengths(self, pieces: list[str]) -> np.ndarray:
        split, whole = {}, []
        for k in pieces:
            m = self.known.fullmatch(k)
            if m and not any(s in k for s in self.special):
                split[k] = [x for x in m.groups() if x]
            else:
                whole.append(k)
        self._fill_parts({p for ps in split.values() for p in ps})
        get = self.parts.__getitem__
        known = dict(zip(whole, self._encode(whole), strict=True))
        return np.array([sum(map(get, split[k])) if k in split else known[k] for k in pieces], dtype=np.int64)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text, as the library counts them for the whole text."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(len(texts), dtype=np.int64)
        before = np.zeros(len(data), dtype=bool)  # a safe end of what stands before the next byte
        before[:-1] = self.prints[data[:-1]]
        before[1:] |= data[:-1] == 0xC3
        after = self.prints[data] | (data == 0xC3)
        starts = np.zeros(len(data), dtype=bool)
        starts[1:-1] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        # a cut never looks across the edge of a text: an edge is a cut, and a space beside one stays with its text
        edge = offsets[1:-1]
        last = edge[edge > 0] - 1
        starts[last] &= np.isin(last, offsets[:-1])
        starts = np.flatnonzero(starts)
        ends = np.append(starts[1:], len(data))
        hashes, first, which = _distinct(data, starts, ends)
        if len(new := self.whole.find(hashes)):
            self.whole.add(hashes[new], self._lengths(span_strings(data, starts[first[new]], ends[first[new]])))
        lengths = np.append(0, np.cumsum(self.whole.size[self.whole.at(hashes)][which]))
        return np.diff(lengths[np.searchsorted(starts, offsets)])


class IdEncoder:
    """Token ids of a lower-casing BPE that drops white space; the ids of a text are those of its white-space pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # for single lower-case Latin words, which its normalizer leaves as they are
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.whole, self.parts = HashCache(), Cache()
        self.known = re.compile(rf"([{_LATIN}]+)({_MARKS}*)")
        self.gap = np.zeros(256, dtype=bool)
        self.gap[[0x20, 0x0A, 0x09]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill_parts(self, parts: set[str]) -> None:
        new = self.parts.missing(parts)
        words = [x for x in new if x.isalpha()]
        for group, enc in zip(g := _groups(words), self.bare.encode_batch_fast([" ".join(x) for x in g], add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(ends) == len(group):
                ids, at = ids.tobytes(), 0
                for k, end in zip(group, ends.tolist(), strict=True):
                    self.parts[k] = ids[at:end]
                    at = end
            else:
                self.parts.update(zip(group, self._encode(group), strict=True))
        rest = [x for x in new if x not in self.parts]
        self.parts.update(zip(rest, self._encode(rest), strict=True))

    def _ids(self, pieces: list[str]) -> list[bytes]:
        split, whole = {}, []
        for k in pieces:
            if m := self.known.fullmatch(k):
                split[k] = [m[1].lower(), m[2]] if m[2] else [m[1].lower()]
            else:
                whole.append(k)
        self._fill_parts({p for ps in split.values() for p in ps})
        get = self.parts.__getitem__
        known = dict(zip(whole, self._encode(whole), strict=True))
        return [b"".join(map(get, split[k])) if k in split else known[k] for k in pieces]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the offsets of each text's."""
        data, offsets = text_bytes(texts)
        is_piece = ~self.gap[data]
        first, last = is_piece.copy(), is_piece.copy()
        first[1:] &= ~is_piece[:-1]
        last[:-1] &= ~is_piece[1:]
        edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        first[edge] = is_piece[edge]
        last[edge - 1] = is_piece[edge - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        hashes, first, which = _distinct(data, starts, ends)
        if len(new := self.whole.find(hashes)):
            got = self._ids(span_strings(data, starts[first[new]], ends[first[new]]))
            self.whole.add(hashes[new], np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4, np.frombuffer(b"".join(got), dtype="<u4"))
        which = self.whole.at(hashes)[which]
        size = self.whole.size[which]
        to = np.append(0, np.cumsum(size))
        at = np.arange(to[-1]) + np.repeat(self.whole.begin[which] - to[:-1], size)
        return self.whole.flat[at], to[np.searchsorted(starts, offsets)]


_ENCODERS: dict[tuple, object] = {}


def encoder(kind: type, path: str):
    """The encoder of this Python worker, made once."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]
