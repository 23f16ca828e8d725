"""Hashes and minima over sliding windows of arrays."""

from __future__ import annotations

import numpy as np

ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hash(codes: np.ndarray, window: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every window, by doubling."""
    power, span, now, out, done = base, 1, codes, None, 0
    while True:
        if window & span:
            if out is None:
                out, done = now, span
            else:  # now covers the first `span` symbols, out the `done` after them
                n = len(codes) - span - done + 1
                out = now[:n] + np.uint64(power) * out[span : span + n]
                done += span
        if span * 2 > window:
            return out
        now = now[: len(now) - span] + np.uint64(power) * now[span:]
        power, span = power * power % (1 << 64), span * 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
