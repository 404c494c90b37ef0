"""Polynomial hashes of byte ranges modulo 2^64, by prefix sums (used inside tasks)."""
from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20)
VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if _powers.get("n", 0) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole 64-bit word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spread(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash, evenly even where the hashes were chosen for being small (hashed once more)."""
    h = mix(h ^ np.uint64(BASE))
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


class Prefixes:
    """Hashes of any ranges of a buffer: equal bytes, wherever they lie, hash alike."""

    def __init__(self, raw: np.ndarray, value: np.ndarray = VALUE, least: int = 1 << 20):
        up, self.down = powers(max(len(raw) + 1, least))
        self.total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(value[raw] * up[:len(raw)], out=self.total[1:])

    def __call__(self, start, stop) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * self.down[start])
