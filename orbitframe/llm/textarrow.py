"""Vectorised word and n-gram hashing straight on Arrow string buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, i.e. ``[^\\x20\\x09-\\x0D]+``; in UTF-8
no multi-byte character holds one of these bytes, so splitting bytes equals splitting characters. Hashes
of words and of runs of words are sums of (value x key of its place), one random odd key per place, then mixed: a few
vector operations per byte and no Python object per word. Keys that are powers of one base would not do: modulo
2**64 regular texts of a thousand characters then have equal sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 2 << 20
_BYTE_BASE = 0x9E3779B97F4A7C15 | 5
BYTE_SEED, WORD_SEED = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SECOND_SEEDS = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
HELD_KEYS = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
BYTE_VALUE_LOWER = BYTE_VALUE[LOWER]

_keys: dict[int, np.ndarray] = {}


def place_keys(seed: int, place: np.ndarray) -> np.ndarray:
    """A random odd number for each place. Those of the first places are held."""
    make = lambda at: mix(at.astype(U64) * U64(0xA0761D6478BD642F) + U64(seed)) | U64(1)
    if seed not in _keys:
        _keys[seed] = make(np.arange(HELD_KEYS))
    return _keys[seed][place] if not len(place) or place.max() < HELD_KEYS else make(place)


def keyed_hash(values: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each run of values; runs follow one another and have at least one value each."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * place_keys(seed, ranges(lengths)), out=total[1:])
    ends = np.cumsum(lengths)
    return mix(total[ends] - total[ends - lengths] + lengths.astype(U64) * U64(0x2545F4914F6CDD1D))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``budget`` bytes each (one row may exceed it), so temporaries stay small."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + budget, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words of a slice of rows: byte ranges, 64-bit hashes, and each row's range of words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, second: bool = False):
        n = len(data)
        self.data, self.off = data, off
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.rows = np.zeros(len(off), np.int64)
            self.hash = self.hash2 = np.zeros(0, U64)
            return
        space = SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before, after = edge[:n].copy(), edge[1:].copy()
        before[0] = after[-1] = True
        before[1:] |= space[:-1]
        after[:-1] |= space[1:]
        word = ~space
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.rows = np.searchsorted(self.starts, off)
        values, lengths = (BYTE_VALUE_LOWER if lower else BYTE_VALUE)[data[word]], self.ends - self.starts
        self.hash = keyed_hash(values, lengths, BYTE_SEED)
        self.hash2 = keyed_hash(values, lengths, SECOND_SEEDS[0]) if second else None

    def grams(self, k: int, second: bool = False) -> np.ndarray:
        """Hash of the k words from each word on; entries that would cross the end of a row are meaningless."""
        h, seed = (self.hash2, SECOND_SEEDS[1]) if second else (self.hash, WORD_SEED)
        n = len(h) - k + 1
        if n < 1:
            return np.zeros(0, U64)
        total = np.zeros(n, U64)
        for j, key in enumerate(place_keys(seed, np.arange(k))):
            total += h[j : n + j] * key
        return mix(total)


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each byte range, independent of where it lies: a polynomial, for ranges whose hashes may coincide."""
    p, inv = powers(base, len(values))
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * p, out=total[1:])
    return mix((total[ends] - total[starts]) * inv[np.minimum(starts, len(values) - 1)] + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
