"""Ranks of byte strings by prefix doubling, in vectorised numpy.

The rank of 8 bytes is those bytes, as a scrambled integer that no two of them share. The rank of 2 k bytes at a place is a name of the pair
(rank of k bytes there, rank of k bytes k later). A length between k and 2 k is named by two ranks of k bytes that overlap, a longer one by as many as cover it. So
equal strings have equal ranks wherever they lie, without any list of all ranks.

A pair's name mixes both ranks by multiplication and then by shifts, which keeps no structure of the text: strings that are built alike (periodic,
Thue-Morse) are no likelier to share a rank than random ones, 2**-64 for one family. Families of other seeds are independent from 16 bytes on.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def octets(data: np.ndarray) -> np.ndarray:
    """The rank of the 8 bytes at each place: one to one."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, U64)
    return mix64(np.ndarray((n,), "<u8", np.ascontiguousarray(data).data, 0, (1,)))


class Ranks:
    """One family of names of pairs."""

    _made: dict = {}

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.left, self.right, self.last = (rng.integers(1, 2**63, 3, dtype=np.uint64) * U64(2)) + U64(1)

    @classmethod
    def get(cls, seed: int) -> Ranks:
        return cls._made.setdefault(seed, cls(seed))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a * self.left
        out += b * self.right
        out ^= out >> U64(32)
        out *= self.last
        out ^= out >> U64(29)
        return out

    def apart(self, ranks: np.ndarray, offset: int) -> np.ndarray:
        """Names of the pairs of ranks at places that lie ``offset`` apart."""
        return self.pair(ranks[:-offset], ranks[offset:]) if len(ranks) > offset else np.zeros(0, U64)

    def doubled(self, ranks: np.ndarray, have: int, want: int) -> np.ndarray:
        """Ranks of ``want`` bytes at each place, from those of ``have`` bytes."""
        while have < want:
            ranks, have = self.apart(ranks, have), 2 * have
        return ranks

    def cover(self, ranks: np.ndarray, size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of the strings from ``start`` to ``end``, none shorter than ``size``, from the ranks of ``size`` bytes that cover them."""
        last = end - size
        out, at = ranks[start], size
        while True:
            out = self.pair(out, ranks[np.minimum(start + at, last)])
            if (start + at >= last).all():
                return out
            at += size
