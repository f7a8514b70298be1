"""Exact quantiles of a column of any size and any number of distinct values.

A double has a place among all doubles, a number of 64 bits. Four passes each settle 16 bits
of the places of the values that are wanted: a task counts, for each wanted beginning, how
many of its values go on with which 16 bits. No task and no message holds more than 65,536
counts for each wanted rank, and no row is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.session import stage

_DIGITS, _DIGIT_BITS = 4, 16
_SIGN = np.uint64(1 << 63)


def _places(values: np.ndarray) -> np.ndarray:
    """Where values stand among all doubles; -0.0 stands with 0.0, and NaN at the end."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    bits = np.where(np.isnan(values), np.uint64(0x7FF8 << 48), bits)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _value(place: int) -> float:
    bits = place & ~(1 << 63) if place >> 63 else ~place & (1 << 64) - 1
    return float(np.uint64(bits).view(np.float64))


def _count_batches(begun: Sequence[int], digit: int):
    """``(begun, digit, n)``: how many values go on from each beginning with which digit."""
    shift = np.uint64(64 - _DIGIT_BITS * (digit + 1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {b: np.zeros(1 << _DIGIT_BITS, np.int64) for b in begun}
        for batch in batches:
            places = _places(batch.column(0).to_numpy(zero_copy_only=False).astype(float)) >> shift
            heads, digits = places >> np.uint64(_DIGIT_BITS), (places & np.uint64(0xFFFF)).astype(np.int64)
            for b, held in counts.items():
                held += np.bincount(digits[heads == np.uint64(b)], minlength=len(held))
        for b, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), b, np.int64)), pa.array(at), pa.array(held[at])], names=["begun", "digit", "n"]
            )

    return counted


def values_at(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at the given ranks, from 0, of a column of doubles without nulls.

    ``df`` should be stored and hold the column alone, for it is read four times.
    """
    # Per rank, the bits that are settled and the rank among the values that share them.
    wanted = {rank: (0, rank) for rank in ranks}
    for digit in range(_DIGITS):
        begun = sorted({head for head, _ in wanted.values()})
        counts = df.select(F.col(column).cast("double")).mapInArrow(
            _count_batches(begun, digit), "begun long, digit long, n long"
        )
        counts = counts.groupBy("begun", "digit").agg(F.sum("n").alias("n"))
        ends: dict[int, tuple[list[int], np.ndarray]] = {}
        # At most 65,536 rows per wanted rank.
        rows = sorted(map(tuple, counts.collect()))
        for b in begun:
            mine = [(d, n) for head, d, n in rows if head == b]
            ends[b] = [d for d, _ in mine], np.cumsum([n for _, n in mine])
        for rank, (head, left) in wanted.items():
            digits, end = ends[head]
            at = int(np.searchsorted(end, left, "right"))
            if at == len(digits):
                raise IndexError(f"rank {rank} is beyond the values")
            before = int(end[at - 1]) if at else 0
            wanted[rank] = (head << _DIGIT_BITS | digits[at], left - before)
    return {rank: _value(place) for rank, (place, _) in wanted.items()}


def quantiles(df: DataFrame, column: str, shares: Sequence[float] = (0.5,)) -> list[float | None]:
    """Exact quantiles of a column, straight lines between neighbouring ranks; nulls are left
    out, and without values every quantile is None. NaN is the greatest value."""
    values = df.select(F.col(column).cast("double").alias(column)).where(F.col(column).isNotNull())
    values = stage(values, "values")
    n = values.count()
    if not n:
        return [None] * len(shares)
    at = [share * (n - 1) for share in shares]
    found = values_at(values, column, sorted({r for a in at for r in (math.floor(a), math.ceil(a))}))
    out = []
    for a in at:
        low, high = found[math.floor(a)], found[math.ceil(a)]
        out.append(low if low == high else low + (high - low) * (a - math.floor(a)))
    return out
