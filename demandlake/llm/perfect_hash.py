"""Minimal perfect hashing of distinct 64-bit keys, in levels of bits.

A level has two bits a key. A key that meets no other at its place sets the bit there and is
done; the others go on to the next level. A key's slot is the number of bits set before its
own, so ``n`` keys have the slots 0 to ``n - 1`` and cost about four bits each.
"""

from __future__ import annotations

import numpy as np

from demandlake.llm.text import mix

ROOM = 2
_MOST_LEVELS = 200


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = mix(np.array([level + 1], np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (mix(keys ^ seed) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots of keys; a key that was not hashed may get a slot too, so callers compare the
    key that is kept there."""

    def __init__(self, levels: list[np.ndarray]):
        self._levels = levels
        self._ranks, before = [], 0
        for words in levels:
            ends = before + np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self._ranks.append(np.concatenate(([before], ends[:-1])))
            before = int(ends[-1])
        self.size = before

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        while len(left):
            if len(levels) == _MOST_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = -(-ROOM * len(left) // 64) * 64
            places = _places(left, len(levels), size)
            alone = np.bincount(places, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[places]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level holds it."""
        keys = keys.astype(np.uint64)
        slots, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self._levels, self._ranks)):
            if not len(open_):
                break
            places = _places(keys[open_], level, 64 * len(words))
            word, bit = words[places >> 6], (places & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slots[open_[hit]] = ranks[places[hit] >> 6] + below[hit]
            open_ = open_[~hit]
        return slots

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self._levels), *map(len, self._levels)], np.uint64)
        return b"".join([sizes.tobytes(), *(words.tobytes() for words in self._levels)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        values = np.frombuffer(raw, np.uint64)
        n = int(values[0])
        ends = np.cumsum(values[:n + 1].astype(np.int64)[1:]) + n + 1
        return cls([values[end - int(size):end] for end, size in zip(ends.tolist(), values[1:n + 1])])
