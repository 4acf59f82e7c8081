"""Vectorised 64-bit hashes of byte strings within a buffer."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(4)
def _powers(base: int, bits: int) -> np.ndarray:
    """base ** 0, 1, 2, ..., by doubling."""
    out = np.ones(1 << bits, U)
    for k in range(bits):
        out[1 << k : 2 << k] = out[: 1 << k] * U(pow(base, 1 << k, 1 << 64))
    return out


@lru_cache(1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(_BASE))


class Prefixes:
    """Polynomial prefix hashes of a buffer; any piece of it is hashed in constant time, wherever it lies."""

    def __init__(self, buffer: np.ndarray):
        bits = max(21, int(len(buffer) + 1).bit_length())
        self.sums = np.zeros(len(buffer) + 1, U)
        np.cumsum(_letters()[buffer] * _powers(_BASE, bits)[: len(buffer)], out=self.sums[1:])
        self.back = _powers(_INVERSE, bits)

    def hash(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """Of buffer[start:end], for arrays of places or slices of the same length."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start])
