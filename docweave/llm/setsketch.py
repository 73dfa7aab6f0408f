"""SetSketch registers in numpy: exponentially spaced truncated minima.

Register i of a set holds floor(1 - log_b x), cut to 0 .. Q + 1, where x is the least of the set's exponentially
distributed hash values of rate RATE. Registers of a union are the maxima of the registers, so sketches merge;
two sets agree in a register about as often as their Jaccard similarity says, so bands of registers find similar
sets; and the counts of greater, smaller and equal registers give the similarity of largest likelihood.
"""

from __future__ import annotations

import numpy as np

REGISTERS, B, RATE, Q = 128, 1.001, 20.0, 65534

_RNG = np.random.default_rng(20210101)
_FACTOR = _RNG.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows x REGISTERS of the sets that begin at `first` among the 64-bit hashes h; no set is empty."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.empty((REGISTERS, len(first)), np.uint32)
    value = np.empty_like(x)
    for i in range(REGISTERS):
        np.multiply(x, _FACTOR[i], out=value)
        value += _SHIFT[i]
        np.minimum.reduceat(value, first, out=least[i])
    spaced = -np.log1p(-(least.T + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(spaced) / np.log(B)), 0, Q + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of largest likelihood for pairs of rows, given the sets' sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (B - 1) / B) / np.log(B)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        worse = likelihood(left) < likelihood(right)
        low, high = np.where(worse, left, low), np.where(worse, high, right)
    return (low + high) / 2
