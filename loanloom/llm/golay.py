"""The perfect binary Golay code of length 23, on numpy arrays.

Every 23-bit word lies within three bits of exactly one codeword. Words that differ in at most two
bits have a word in common that differs from each of them in at most one; so the codewords of all
words within one bit of a word are keys, six at most, of which any two such words share one.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, MESSAGE = 23, 12
CHECKS = LENGTH - MESSAGE
# generator polynomial of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value)
GENERATOR = 0b1100_0111_0101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits; the error that belongs to a syndrome."""
    low = np.array([_remainder(x) for x in range(1 << MESSAGE)], dtype=np.int64)
    high = np.array([_remainder(x << MESSAGE) for x in range(1 << CHECKS)], dtype=np.int64)
    errors = np.zeros(1 << CHECKS, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            word = sum(1 << b for b in bits)
            errors[_remainder(word)] = word
    return low, high, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Message bits of the codeword within three bits of each word."""
    low, high, errors = _tables()
    syndrome = low[words & ((1 << MESSAGE) - 1)] ^ high[words >> MESSAGE]
    return (words ^ errors[syndrome]) >> CHECKS


def neighbour_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, key)`` for every distinct key of every word."""
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)])
    keys = np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones_like(keys, dtype=bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]
