"""Words, lines and rolling hashes of whole texts, vectorised over Arrow batches.

Every helper works on the UTF-8 bytes of a run of texts laid end to end, and takes
about a megabyte of bytes at a time (one text at least), so a task's memory follows
its longest text and not the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_VALUES = _BYTE_VALUES[LOWER]


def give_back() -> None:
    """Arrow's unused memory goes to the system: a worker lives on through other stages, and
    what it kept would add to what they need."""
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, data, offsets)`` of runs of texts of about ``size`` bytes."""
    data, offsets = utf8(column)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(max(end, first + 1), len(column))
        at = offsets[first:end + 1]
        yield first, end, data[at[0]:at[-1]], at - at[0]
        first = end
    give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    up, down = _power_table(max(1 << 20, 1 << (n - 1).bit_length() if n > 1 else 1))
    return up[:n], down[:n]


class RangeHash:
    """Hashes of any ranges of a sequence, from one running sum."""

    def __init__(self, values: np.ndarray):
        up, self._down = powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


def byte_hash(data: np.ndarray) -> RangeHash:
    return RangeHash(_BYTE_VALUES[data])


@dataclass
class Spans:
    """Words or lines of a run of texts: byte ranges, text index, and hash."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray  # index of each text's first span, and the end of the last
    hashes: np.ndarray

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First spans and hashes of all runs of ``n`` spans inside one text."""
        if len(self.starts) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(len(self.starts) - n + 1)
        at = at[self.text[at] == self.text[at + n - 1]]
        return at, RangeHash(self.hashes)(at, at + n)


def _spans(data, offsets, inside, values=_BYTE_VALUES) -> Spans:
    """Maximal runs of ``inside`` bytes, broken at the edges of texts; ``values`` are what
    bytes are hashed by."""
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets)
    return Spans(starts, ends, text, first, RangeHash(values[data])(starts, ends))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Spans:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    # Two comparisons take less time than a look-up per byte.
    inside = (data != 32) & (data - np.uint8(9) > 4)
    return _spans(data, offsets, inside, _LOWER_VALUES if lower else _BYTE_VALUES)


def lines(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Non-empty lines of each text, split at newlines."""
    return _spans(data, offsets, data != 10)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window of ``length`` from one of ``starts``,
    which are distinct and leave their window room."""
    steps = np.zeros(n + 1, np.int32)
    steps[starts] += 1
    steps[starts + length] -= 1
    return np.cumsum(steps[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each text, given where each text begins."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[first[1:]] - sums[first[:-1]]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
