"""Words of whole texts as arrays of hashes, for use inside tasks.

A word is a run of bytes outside a set of separators, which by default are space and the five ASCII
white-space controls. Hashes are polynomials over the bytes modulo 2**64, read off a running sum, and then mixed:
no Python object is made for a word. Two seeds give independent hashes of the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that are hashed at once; it bounds a worker's memory, not a text's length.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of a well-known public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: An odd number, and its inverse modulo 2**64.
BASE = 0x9D39247E33776D41
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, ``n`` at least."""
    return _ready(max(16, n.bit_length())) if n < 1 << 21 else _ready.__wrapped__(n.bit_length())


@lru_cache(2)
def _ready(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (BASE, INVERSE):
        a = np.ones((1 << bits) + 1, np.uint64)
        a[1:] = np.uint64(x)
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


@lru_cache(16)
def _byte_values(seed: int, lower: bool) -> np.ndarray:
    values = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A mixed hash of each run ``values[start:end]``; seeds give independent hashes."""
    if seed:
        values = mix(values + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    powers, inverse = _powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=total[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * inverse[starts] + length * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of some texts: ``hashes`` of all of them, ``at[i]:at[i + 1]`` being those of text ``i``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, separators: tuple[int, ...], seed: int):
        apart = np.zeros(256, bool)
        apart[list(separators)] = True
        inside = ~apart[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True  # a text's end also ends a word
        left = np.ones(len(data), bool)
        left[1:] = ~inside[:-1]
        left |= first[:-1]
        right = np.ones(len(data), bool)
        right[:-1] = ~inside[1:]
        right |= first[1:]
        self.starts = np.flatnonzero(inside & left)
        self.ends = np.flatnonzero(inside & right) + 1
        self.data = data
        self.at = np.searchsorted(self.starts, offsets)
        self.hashes = rolling(_byte_values(seed, lower)[data], self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def windows(self, size: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of each run of ``size`` words within one text, in order."""
        counts = self.counts()
        room = np.repeat(self.at[1:], counts) - np.arange(len(self.hashes))
        starts = np.flatnonzero(room >= size)
        return rolling(self.hashes, starts, starts + size, seed), starts


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of string values; null is as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def sliced(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of texts with about ``limit`` bytes, or of one longer text."""
    data, at = buffers(texts)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words_of(texts: pa.Array, lower: bool = False, separators: tuple[int, ...] = SPACE, seed: int = 0) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) of consecutive runs of texts."""
    for i, j, data, offsets in sliced(texts):
        yield i, j, Words(data, offsets, lower, separators, seed)
