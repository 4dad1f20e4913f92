"""Hilbert curve positions of grid points, many at a time."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of every row of ``cells`` (n x d, each below 2**bits) along a Hilbert curve.

    The curve is followed from the coarsest bit down: each level's cell is mirrored and
    turned into the frame of the curve's piece that runs through it, then all bits are
    interleaved in Gray code order. ``d * bits`` may not exceed 63.
    """
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    if d * bits > 63:
        raise ValueError("keys have at most 63 bits")
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for i in range(d):
            mirror = (x[i] & high) != 0
            swapped = np.where(mirror, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(mirror, low, swapped)
            if i:
                x[i] ^= swapped
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> level & 1)
    return key
