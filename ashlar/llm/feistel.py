"""Keyed pseudorandom permutations of 0..n-1: a balanced Feistel network with cycle-walking."""

from __future__ import annotations

import numpy as np

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiplicative hash (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """index -> its place under the permutation of range(n) that key names.

    n and key may be arrays, one entry for each index.  The network works on the
    smallest even number of bits that holds n (at least 2); results of n or more
    walk on along their cycle, fewer than four steps on average.
    """
    x = np.asarray(index, dtype=np.uint64).copy()
    n = np.broadcast_to(np.asarray(n, dtype=np.uint64), x.shape)
    key = np.broadcast_to(np.asarray(key, dtype=np.uint64), x.shape)
    if x.size == 0:
        return x
    if (x >= n).any():
        raise ValueError("index out of range")
    bits = np.ceil(np.log2(np.maximum(n.astype(np.float64), 2.0))).astype(np.uint64)
    bits = np.where((np.uint64(1) << np.minimum(bits, np.uint64(62))) < n, bits + np.uint64(1), bits)
    half = np.maximum((bits + np.uint64(1)) // np.uint64(2), np.uint64(1))
    todo = np.arange(x.size)
    with np.errstate(over="ignore"):
        while todo.size:
            h, k, v = half[todo], key[todo], x[todo]
            mask = (np.uint64(1) << h) - np.uint64(1)
            left, right = v >> h, v & mask
            for r in range(ROUNDS):
                f = _mix(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03) * np.uint64(r + 1)) & mask
                left, right = right, left ^ f
            x[todo] = (left << h) | right
            todo = todo[x[todo] >= n[todo]]
    return x
