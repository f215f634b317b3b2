"""Vectorised word hashing over Arrow string columns.

A batch of texts is handled as the one byte buffer that Arrow already holds, so
no Python string is made per word. A word is ``[^\\x20\\x09-\\x0D]+``; in UTF-8
no byte of a longer character can be mistaken for one of those six.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd 64-bit constants of the rolling hashes (fixed so every executor agrees).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
MASK64 = (1 << 64) - 1
#: Bytes handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept per worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        table = np.full(size, base & MASK64, np.uint64)
        table[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.multiply.accumulate(table)
    return _powers[base][:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    x = x.copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of consecutive texts: byte spans in ``buf``, hashes, and for text i
    the words ``first[i]:first[i + 1]``. ``rows`` is the batch slice they are of."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    rows: tuple[int, int]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; meaningless where fewer are left in its text."""
        return roll(self.hash, k)

    def whole(self, k: int) -> np.ndarray:
        """Which words start a window of k words within their text."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hash))
        return left >= k


def roll(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    if n >= k:
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(hashes * powers(WORD_BASE, n), out=total[1:])
            out[: n - k + 1] = mix((total[k:] - total[:-k]) * powers(inverse(WORD_BASE), n - k + 1))
    return out


def strings(column: pa.Array) -> pa.Array:
    """The column as plain strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and the bytes of a large_string column."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def split(off: np.ndarray, data: np.ndarray, lo: int, hi: int) -> Words:
    """Words of the texts lo..hi-1."""
    base = off[lo]
    buf = data[base : off[hi]]
    edges = off[lo : hi + 1] - base
    n = len(buf)
    space = IS_SPACE[buf]
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = space[:-1]
    fresh[edges] = True
    ends = np.ones(n + 1, bool)
    ends[1:n] = space[1:]
    ends[edges] = True
    solid = ~space
    start = np.flatnonzero(fresh[:n] & solid)
    end = np.flatnonzero(ends[1:] & solid) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[buf] * powers(BYTE_BASE, n), out=total[1:])
        h = mix((total[end] - total[start]) * powers(inverse(BYTE_BASE), max(n, 1))[start])
    return Words(buf, start, end, h, np.searchsorted(start, edges), (lo, hi))


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, a longer text alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(column: pa.Array) -> Iterator[Words]:
    """Words of a string column, a chunk of whole texts at a time."""
    off, data = buffers(strings(column))
    for lo, hi in chunks(off):
        yield split(off, data, lo, hi)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
