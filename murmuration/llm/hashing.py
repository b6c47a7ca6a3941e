"""Mixing of 64-bit values in NumPy."""

from __future__ import annotations

import numpy as np


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit values in which every bit depends on all others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def uniform(x: np.ndarray) -> np.ndarray:
    """A number inside (0, 1) for each 64-bit value."""
    return ((mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
