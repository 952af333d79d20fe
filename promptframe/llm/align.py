"""Alignment of word sequences inside tasks."""

from __future__ import annotations

import numpy as np


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def extend(a: np.ndarray, b: np.ndarray, i: int, j: int, step: int, drop: int = 6, cost: int = 2) -> int:
    """How far a match goes on from words i, j in direction ``step``: +1 a match, -``cost`` a difference, up to a drop."""
    best = at = score = n = 0
    while 0 <= i < len(a) and 0 <= j < len(b):
        n += 1
        score += 1 if a[i] == b[j] else -cost
        if score > best:
            best, at = score, n
        if score <= best - drop:
            break
        i, j = i + step, j + step
    return at
