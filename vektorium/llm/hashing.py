"""Hashes of many byte ranges at once, from one running sum over the bytes."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for up to ``n`` bytes; the largest pair is kept."""
    size = 1 << max(16, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = (_powers(BASE, size), _powers(INVERSE, size))
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def range_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``values[first:last]``, the same wherever the range lies. Zeros don't count, so shift bytes by one."""
    n = len(values)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[last] - total[first]) * down[first])
