"""Polynomial hashes of sequences in numpy, modulo 2 ** 64: one prefix sum, then any range in constant time."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finisher, so that all bits of a fingerprint depend on all of a polynomial."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """BASE ** i and BASE ** -i modulo 2 ** 64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b)]) for b in (BASE, INVERSE))
        return self.up, self.down


def prefixes(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of values[i] * BASE ** i; the hash of [i, j) is their difference times BASE ** -i."""
    up, _ = powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out
