"""64-bit hashes of many ranges of one array at once, from running sums of values times powers of an odd base."""

from __future__ import annotations

import numpy as np

BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd
#: A random odd number for each byte.
BYTE_TABLE = np.random.default_rng(12).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))])
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """A hash of values[s:e] for each range."""
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(values * _power(base, len(values)))])
        return mixed((total[ends] - total[starts]) * _power(inverse, len(values) + 1)[starts])
