"""Vectorised passes over UTF-8 text held as one byte buffer and row offsets.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
Word hashes are 64-bit multilinear hashes over the bytes, finished by a mixer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); wraps modulo 2**64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values; a longer stream begins with a shorter one."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed) * U(0xD1342543DE82EF95))


_BYTE = stream(256, 11)
_PLACE = stream(1 << 12, 12) | U(1)


def _place(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = stream(1 << int(n - 1).bit_length(), 12) | U(1)
    return _PLACE


@dataclass
class Words:
    """Words of some rows: byte ranges in the buffer, row numbers, hashes."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    count: np.ndarray  # words of each row
    hash: np.ndarray | None


def words(buf: np.ndarray, offsets: np.ndarray, hashed: bool = True, apart: np.ndarray = _SPACE) -> Words:
    """``apart`` marks the bytes that separate words."""
    n = len(offsets) - 1
    solid = ~apart[buf]
    if not len(buf) or not solid.any():
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(n, np.int64), none.astype(U))
    fresh = np.zeros(len(buf) + 1, bool)
    fresh[offsets] = True  # a row's first byte never continues the row before
    first = solid.copy()
    first[1:] &= ~solid[:-1] | fresh[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | fresh[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    h = hash_ranges(LOWER[buf], start, end) if hashed else None
    return Words(start, end, row, np.bincount(row, minlength=n), h)


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of disjoint byte ranges in ascending order; equal bytes, equal hash."""
    size = end - start
    out = np.zeros(len(start), U)
    full = size > 0
    if full.any():
        s, k = start[full], size[full]
        at = np.zeros(len(k), np.int64)
        np.cumsum(k[:-1], out=at[1:])
        kind = np.int32 if len(buf) < 1 << 31 else np.int64  # half the memory where that is enough
        pos = np.arange(int(k.sum()), dtype=kind)
        pos -= np.repeat(at.astype(kind), k)
        src = np.repeat(s.astype(kind), k)
        src += pos
        with np.errstate(over="ignore"):
            out[full] = np.add.reduceat(_BYTE[buf[src]] * _place(int(k.max()))[pos], at)
    with np.errstate(over="ignore"):
        return mix(out + size.astype(U) * U(0x9E3779B97F4A7C15))
