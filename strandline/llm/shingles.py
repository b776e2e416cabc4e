"""Word shingles and MinHash in vectorised numpy.

A word is a run without the ASCII blanks \\x20 and \\x09 to \\x0D; a shingle is ``width`` (5) words in a row. A text of 1 to
``width`` - 1 words has one shingle, all its words; a text without words has none. Words and shingles are 64-bit names: a word's eight-byte pieces,
the last one filled with zeros, and its length are folded by the pairs of ``ranks``; words over ``LONG`` bytes are named by blake2b. MinHash takes for each of many universal permutations a x + b (mod 2**32, a odd) the least value over the shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .ranks import U64, Ranks, mix64

WIDTH = 5
#: Bytes of a word that are folded piece by piece.
LONG = 64
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: The signature value of a text without words.
NOTHING = np.uint32(0xFFFFFFFF)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of the texts that lie side by side in ``data``."""
    inside = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    last = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    return first, last


def word_names(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit names of the words from ``first`` to ``last``."""
    if not len(first):
        return np.zeros(0, U64)
    family, size = Ranks.get(11), last - first
    eight = np.ndarray((len(data),), "<u8", np.concatenate((data, np.zeros(8, np.uint8))).data, 0, (1,))
    out = mix64(size.astype(U64))
    for k in range(0, min(int(size.max()), LONG), 8):
        some = np.flatnonzero(size > k) if k else slice(None)
        rest = 8 * np.minimum(size[some] - k, 8).astype(U64)
        piece = eight[first[some] + k] & (~U64(0) >> (U64(64) - rest))
        out[some] = family.pair(out[some], mix64(piece))
    for i in np.flatnonzero(size > LONG):
        out[i] = U64(int.from_bytes(hashlib.blake2b(data[first[i] : last[i]], digest_size=8).digest(), "little"))
    return mix64(out)


def shingles(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle names of all texts, and the bounds (n + 1) of each text's part; repeats are kept."""
    first, last = word_spans(data, bounds)
    word = word_names(data, first, last)
    at = np.searchsorted(first, bounds)
    count = np.diff(at)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_bounds = np.concatenate(([0], np.cumsum(n)))
    start = np.repeat(at[:-1] - out_bounds[:-1], n) + np.arange(out_bounds[-1])
    end = np.repeat(at[1:], n)
    out = np.zeros(len(start), U64)
    padded = np.concatenate((word, np.zeros(width, U64)))
    for k in range(width):
        out = out * U64(0x9E3779B97F4A7C15) + np.where(start + k < end, padded[np.minimum(start + k, len(padded) - 1)], U64(0))
    return mix64(out), out_bounds


class MinHash:
    """Signatures of ``n`` 32-bit values; the permutations depend on ``seed`` alone."""

    _made: dict = {}

    def __init__(self, n: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]

    @classmethod
    def get(cls, n: int, seed: int = 5) -> MinHash:
        return cls._made.setdefault((n, seed), cls(n, seed))

    def sign(self, names: np.ndarray, bounds: np.ndarray, piece: int = 512) -> np.ndarray:
        low = (names >> U64(32)).astype(np.uint32)
        out = np.full((len(bounds) - 1, len(self.a)), NOTHING, np.uint32)
        for d in range(len(bounds) - 1):
            for s in range(bounds[d], bounds[d + 1], piece):
                x = low[s : min(s + piece, bounds[d + 1])]
                np.minimum(out[d], (self.a * x + self.b).min(axis=1), out=out[d])
        return out
