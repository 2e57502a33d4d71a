"""Ranks by prefix doubling.

The rank of a substring is a 64-bit name: equal substrings have equal names, and
the name of 2h symbols is made from the pair of names of h symbols at offsets 0
and h (Karp, Miller and Rosenberg's naming, with a mixed hash in place of the
place in a sorted list).  So a task can rank its own positions, and Spark only
has to bring equal ranks together.
"""

from __future__ import annotations

import numpy as np

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xBF58476D1CE4E5B9)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rank of pairs of ranks."""
    x = left * _MULTIPLY + right
    x ^= x >> np.uint64(32)
    x *= _FINISH
    x ^= x >> np.uint64(29)
    return x


def window_ranks(symbols: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all windows of ``length`` symbols, by growing offsets 1, 2, 4, ...;
    a length that is no power of two takes two overlapping windows at last."""
    ranks, h = symbols, 1
    while 2 * h <= length and len(ranks) > h:
        ranks = pair(ranks[:-h], ranks[h:])
        h *= 2
    if len(symbols) < length:
        return symbols[:0]
    if h < length:
        step = length - h
        ranks = pair(ranks[: len(ranks) - step] ^ np.uint64(length), ranks[step:])
    return ranks
