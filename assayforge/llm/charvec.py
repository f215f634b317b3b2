"""Vectorised features over code points: words, character n-grams and their hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from assayforge.llm.textvec import mix

#: Code points handled at once; a longer text is handled alone.
CHUNK_CHARS = 1 << 17
SPACE = 32
_factor = np.random.default_rng(77).integers(1, 2**32, 16, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_tables: dict[str, np.ndarray] = {}


def char_table(name: str) -> np.ndarray:
    """A truth value for each code point: alpha or space."""
    if name not in _tables:
        test = {"alpha": str.isalpha, "space": str.isspace}[name]
        _tables[name] = np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)
    return _tables[name]


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Index ranges of about CHUNK_CHARS characters."""
    lo = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > CHUNK_CHARS:
            yield lo, i
            lo, total = i, 0
        total += len(text) + 1
    if lo < len(texts):
        yield lo, len(texts)


@dataclass
class Chars:
    """Texts as one array of code points with a blank before, between and after them.

    ``first[i]:first[i + 1]`` are the words of text i; ``plain`` has blanks
    wherever no word is; text i begins at ``at[i]`` of it.
    """

    raw: np.ndarray
    plain: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    at: np.ndarray


def split(texts: list[str], letters_only: bool) -> Chars:
    """Words are runs of letters, or of anything but white space."""
    raw = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    at = 1 + np.concatenate([[0], np.cumsum(size)])
    inside = char_table("alpha")[raw] if letters_only else ~char_table("space")[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    return Chars(raw, np.where(inside, raw, SPACE).astype(np.uint32), start, end, np.searchsorted(start, at), at)


def gram_hash(plain: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n characters from each place on (shorter by n - 1)."""
    m = len(plain) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        h = np.full(m, n * 0x3C6EF35F & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h += plain[j : j + m] * _factor[j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
    return h & np.uint32(buckets - 1)


def gram_spans(chars: Chars, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, the places lo:hi at which its n-grams start, blanks around it included."""
    lo = chars.start - 1
    return lo, np.maximum(lo, chars.end + 2 - n)


def span_sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of values[lo:hi] (rows) for each span."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[np.minimum(hi, len(values))] - total[np.minimum(lo, len(values))]


def word_hash(chars: Chars) -> np.ndarray:
    """A 64-bit hash of each word."""
    from assayforge.llm.textvec import BYTE_BASE, inverse, powers

    n = len(chars.plain)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((chars.plain.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)) * powers(BYTE_BASE, n), out=total[1:])
        return mix((total[chars.end] - total[chars.start]) * powers(inverse(BYTE_BASE), n)[chars.start])
