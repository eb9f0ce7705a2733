"""Gradient noise on a simplex lattice in the plane, on arrays in single precision."""

from __future__ import annotations

import numpy as np

# Primes of the lattice's coordinates, the hash's factor, and the scale that brings the noise to -1..1.
PRIME_X, PRIME_Y = 501125321, 1136930381
HASH = 0x27D4EB2D
SCALE = 99.83685446303647
SKEW, UNSKEW = np.float32((3**0.5 - 1) / 2), np.float32((3 - 3**0.5) / 6)


def _gradients() -> np.ndarray:
    """128 directions: five rounds of 24, clockwise from near the north, and one of eight."""
    angles = [82.5 - 15 * (k % 24) for k in range(120)] + [67.5 - 45 * k for k in range(8)]
    return np.column_stack([np.cos(np.radians(angles)), np.sin(np.radians(angles))]).astype(np.float32)


GRADIENTS = _gradients()


def simplex(x: np.ndarray, y: np.ndarray, seed: int = 7, frequency: float = 10.0) -> np.ndarray:
    """Noise at points: the sum of what the three corners of a point's triangle give, each by its gradient and distance."""
    x, y = (np.asarray(v, np.float32) * np.float32(frequency) for v in (x, y))
    t = (x + y) * SKEW
    x, y = x + t, y + t
    i, j = np.floor(x), np.floor(y)
    t = (x - i + (y - j)) * UNSKEW
    x0, y0 = x - i - t, y - j - t
    i, j = i.astype(np.int32), j.astype(np.int32)
    upper = (y0 > x0).astype(np.int32)
    total = np.zeros(x.shape, np.float32)
    with np.errstate(over="ignore"):
        for di, dj in ((np.int32(0), np.int32(0)), (1 - upper, upper), (np.int32(1), np.int32(1))):
            dx, dy = (v - d.astype(np.float32) + (di + dj).astype(np.float32) * UNSKEW for v, d in ((x0, di), (y0, dj)))
            h = (np.int32(seed) ^ (i + di) * np.int32(PRIME_X) ^ (j + dj) * np.int32(PRIME_Y)) * np.int32(HASH)
            g = GRADIENTS[(h ^ h >> 15) >> 1 & 127]
            near = np.maximum(np.float32(0.5) - dx * dx - dy * dy, np.float32(0))
            total += (near * near) ** 2 * (dx * g[..., 0] + dy * g[..., 1])
    return total * np.float32(SCALE)
