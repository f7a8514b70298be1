"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stands in for a missing part of a composite key: xxhash64 skips NULLs, so
# without it (a, NULL) and (NULL, a) would share a key.
MISSING = -1


def hash_key(*parts: Column) -> Column:
    """Non-negative 64-bit key: the hash without its sign bit."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 63) - 1))


def dimension_key(natural: Column) -> Column:
    """Key of one dimension row; NULL stays NULL, as after a left join."""
    return F.when(natural.isNotNull(), hash_key(natural))


def fact_key(link: Column, *ids: Column) -> Column:
    return hash_key(link, *[F.coalesce(i, F.lit(MISSING).cast("bigint")) for i in ids])


def date_key(day: Column) -> Column:
    """yyyyMMdd as an int."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
