"""The binary Golay code (23, 12, 7): tables for list decoding by syndrome."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECKS = 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and for each syndrome six error patterns.

    The patterns are those of up to four bits that lead from a word with this syndrome to a codeword: one where the
    nearest codeword is within two bits (repeated to six), one of three and five of four bits elsewhere. Together
    they are the codewords nearest to any word within one bit, so two words that differ in at most two bits share one.
    """
    single = np.array([_remainder(1 << b) for b in range(LENGTH)], dtype=np.int32)

    def syndromes(first: int, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, dtype=np.int32)
        for b in range(bits):
            out[1 << b : 2 << b] = out[: 1 << b] ^ single[first + b]
        return out

    lists: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            s = 0
            for b in bits:
                s ^= int(single[b])
            lists[s].append(sum(1 << b for b in bits))
    errors = np.empty((1 << CHECKS, 6), dtype=np.int32)
    for s, found in enumerate(lists):
        near = found if bin(found[0]).count("1") == 3 else found[:1]
        errors[s] = (near + [near[0]] * 6)[:6]
    return syndromes(0, 12), syndromes(12, 11), errors


def codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the six indices (12 bits) of its nearby codewords, repeated where there is only one."""
    low, high, errors = tables()
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ errors[syndrome]) >> CHECKS
