"""Vectorised text kernels over Arrow string columns.

All of them view a batch of texts as one byte buffer with document offsets, so that no
Python loop runs per word. Hashes are 64-bit: polynomials modulo 2**64 over random byte
values, finished by a bijective mixer.
"""

from __future__ import annotations

import ctypes
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the memory of a Python worker (a longer text is handled alone).
CHUNK = 1 << 20

_random = np.random.default_rng(20240229)
#: Two sets of random byte values, for two independent hashes.
BYTE_VALUES = _random.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: White space that ends a word: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that begin a code point in UTF-8.
LEAD = (np.arange(256) & 0xC0) != 0x80


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE ** i (or its inverse) for i below n at least."""
    if len(_powers[inverse]) < n:
        steps = np.full(max(n, CHUNK + 1), BASE_INVERSE if inverse else BASE, np.uint64)
        steps[0] = 1
        _powers[inverse] = np.multiply.accumulate(steps)
    return _powers[inverse]


class Bytes:
    """Some whole texts: buf holds their bytes, text i is buf[off[i]:off[i + 1]]; first is the row of text 0."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, first: int):
        self.buf, self.off, self.first = buf, off, first
        self._sums: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.off) - 1

    def hashes(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """64-bit hashes of the substrings buf[start:end]; which: 0 or 1, of two independent hashes."""
        if which not in self._sums:
            sums = self._sums[which] = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[which][self.buf] * powers(len(self.buf))[: len(self.buf)], out=sums[1:])
        sums = self._sums[which]
        return mix((sums[end] - sums[start]) * powers(len(self.buf) + 1, inverse=True)[start])

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every maximal run of bytes that aren't space; runs end with their text."""
        is_word = ~space[self.buf]
        begins, ends = is_word.copy(), is_word.copy()
        begins[1:] &= ~is_word[:-1]
        ends[:-1] &= ~is_word[1:]
        inner = self.off[1:-1]
        inner = inner[(inner > 0) & (inner < len(self.buf))]
        begins[inner] = is_word[inner]
        ends[inner - 1] = is_word[inner - 1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The number of the text that holds each byte position (ascending)."""
        return np.repeat(np.arange(len(self)), np.diff(np.searchsorted(at, self.off)))

    def count(self, at: np.ndarray) -> np.ndarray:
        """How many of the ascending positions lie in each text."""
        return np.diff(np.searchsorted(at, self.off))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_calls = itertools.count(1)


def give_back() -> None:
    """Every few batches, return freed memory to the system: workers live on between stages, and allocators keep what they once had."""
    if next(_calls) % 4 == 0:
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def parts(texts: pa.Array, limit: int = CHUNK) -> Iterator[Bytes]:
    """The texts in runs of at most limit bytes; a longer text comes alone and whole."""
    buf, off = buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield Bytes(buf[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j
    give_back()


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for the others."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(np.asarray(start, np.int64) - (ends - length), length)


class IdCache:
    """Token ids of text units by the units' hashes.

    encode gets a list of distinct units (bytes) and returns flat ids and the number of ids
    of each. The cache begins anew beyond most units, which bounds its memory.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 600_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.key, self.start, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def look_up(self, text: Bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each unit text.buf[start:end]: the place of its ids in self.flat, and their number."""
        hashes = text.hashes(start, end)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.key) + len(keys) > self.most:
            self.clear()
        at = np.searchsorted(self.key, keys)
        known = at < len(self.key)
        known[known] = self.key[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw = text.buf.tobytes()
            flat, n = self.encode([raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(flat), self.used), np.int32)])
            self.flat[self.used : self.used + len(flat)] = flat
            key = np.concatenate([self.key, keys[new]])
            order = np.argsort(key, kind="stable")
            self.key = key[order]
            self.start = np.concatenate([self.start, self.used + np.cumsum(n) - n])[order]
            self.n = np.concatenate([self.n, n])[order]
            self.used += len(flat)
            at = np.searchsorted(self.key, keys)
        return self.start[at][back], self.n[at][back]
