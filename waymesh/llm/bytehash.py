"""Hashes of many substrings of one buffer at once, with numpy.

H(s) is the sum of T[byte] * R**position over the bytes of s, modulo 2**64, then mixed. T is a table of random
odd numbers, R is odd and so has an inverse, and the hash of any substring is a difference of two prefix sums.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1


def _table(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table, int(rng.integers(1 << 40, 1 << 62)) * 8 + 5


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Hasher:
    """Hashes of substrings of a buffer. Equal substrings have equal hashes in every buffer and every process."""

    def __init__(self, seed: int):
        self.table, self.base = _table(seed)
        self.inverse = pow(self.base, -1, 1 << 64)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.size = n
        self.up, self.down = powers(self.base, n), powers(self.inverse, n)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        """codes: bytes, or 64-bit values such as the hashes of words."""
        if len(codes) >= self.size:
            self._grow(2 * len(codes))
        out = np.zeros(len(codes) + 1, np.uint64)
        terms = self.table[codes] if codes.dtype == np.uint8 else codes
        np.cumsum(terms * self.up[: len(codes)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Of every substring of length k."""
        n = len(prefix) - k
        return mix((prefix[k:] - prefix[:n]) * self.down[:n])
