"""Minimal perfect hash functions over pairs of 64-bit hashes, for tables of bounded size that are sent to tasks."""

from __future__ import annotations

import numpy as np

#: Bits per key of a level. Two of three keys find a bit of their own at once.
LOAD = 2
MAX_LEVELS = 64


def _positions(first: np.ndarray, second: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = first + second * np.uint64(2 * level + 1) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))) % np.uint64(bits)


class PerfectHash:
    """Levels of bit arrays after Limasset et al., Fast and Scalable Minimal Perfect Hashing (2017).

    A key's slot is the rank of the first bit it finds set among the positions the levels give it. Every key of the
    set has a slot of its own in 0..n-1; other keys have no slot (-1) or any, so callers verify what is stored there.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        words = np.concatenate([*levels, np.zeros(1, np.uint64)])
        self.words = words
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.size = int(self.ranks[-1])

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        """Over distinct pairs; equal pairs are an error."""
        levels, left = [], np.arange(len(first))
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError(f"{len(left)} keys have equal hashes")
            bits = 64 * max(1, -(-LOAD * len(left) // 64))
            at = _positions(first[left], second[left], len(levels), bits)
            often = np.bincount(at.astype(np.int64), minlength=bits)
            alone = (often == 1).astype(np.uint8)
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            left = left[often[at] != 1]
        return cls(levels)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.full(len(first), -1, np.int64)
        open_ones, base = np.arange(len(first)), 0
        for level, words in enumerate(self.levels):
            if not len(open_ones):
                break
            at = _positions(first[open_ones], second[open_ones], level, 64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, at & np.uint64(63)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_ones[found]] = self.ranks[word[found]] + below[found]
            open_ones, base = open_ones[~found], base + len(words)
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4")
        return sizes.tobytes() + b"".join(words.astype("<u8").tobytes() for words in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        count = int(np.frombuffer(data, "<u4", 1)[0])
        sizes = np.frombuffer(data, "<u4", count, offset=4).tolist()
        levels, at = [], 4 + 4 * count
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, offset=at).astype(np.uint64))
            at += 8 * size
        return cls(levels)
