"""A minimal perfect hash over 64-bit keys: cascading bit arrays.

On each level a key has one place; keys that are alone at theirs set its bit, the others go to the next level. A key's slot is the
number of bits set before its own, so that n keys have the slots 0 to n - 1, at about four bits a key. A key that was not
built in may get any slot, or none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .hashing import mix

#: Bits of a level for each of its keys, and levels at most.
SPARE, LEVELS = 2, 64


@dataclass(frozen=True)
class PerfectHash:
    """words: the bits of all levels; before: bits set before each word; sizes: bits of each level; rest: keys that are left, sorted."""

    words: np.ndarray
    before: np.ndarray
    sizes: np.ndarray
    rest: np.ndarray

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 of a key that has none."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        start = 0
        for level, bits in enumerate(self.sizes.tolist()):
            at = _places(keys[left], level, bits) + start
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            low = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(low)
            left = left[~hit]
            start += bits
        if len(self.rest):
            k = np.searchsorted(self.rest, keys[left])
            found = self.rest[np.minimum(k, len(self.rest) - 1)] == keys[left]
            set_bits = int(self.before[-1]) + int(np.bitwise_count(self.words[-1])) if len(self.words) else 0
            out[left[found]] = set_bits + k[found]
        return out


def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))) % np.uint64(bits)).astype(np.int64)


def build(keys: np.ndarray) -> PerfectHash:
    """keys: distinct uint64."""
    words, sizes = [], []
    for level in range(LEVELS):
        if not len(keys):
            break
        bits = -(-SPARE * len(keys) // 64) * 64
        at = _places(keys, level, bits)
        alone = np.bincount(at, minlength=bits) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(bits)
        keys = keys[~alone[at]]
    flat = np.concatenate(words).astype(np.uint64) if words else np.zeros(0, np.uint64)
    before = np.cumsum(np.bitwise_count(flat), dtype=np.int64) - np.bitwise_count(flat)
    return PerfectHash(flat, before, np.array(sizes, np.int64), np.sort(keys))
