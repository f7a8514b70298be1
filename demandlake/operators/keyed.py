"""First row per key and rows with a new key: the two steps of every load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``.

    The rank filter is pushed below the shuffle (a partial window group limit),
    so each map task sends at most one row per key and a key that holds a third
    of the rows costs its reducer no more than any other.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def total_order(df: DataFrame, first: Sequence[str], keys: Sequence[str]) -> list[str]:
    """``first``, then every other column, so that ties are left only between equal rows."""
    return [*first, *(c for c in df.columns if c not in first and c not in keys)]


def new_rows(
    incoming: DataFrame,
    existing: DataFrame,
    key: str = "job_link",
    order: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``incoming`` whose key ``existing`` lacks, one per key; NULL keys are dropped.

    ``existing`` is cut down to the incoming keys first. A daily batch is small
    beside the table, so the planner broadcasts its keys and the table's key
    column is read without a shuffle; when the batch is large, both joins use
    the same shuffle partitioning.
    """
    batch = first_per_key(
        incoming.where(F.col(key).isNotNull()), [key], total_order(incoming, order, [key])
    )
    candidates = incoming.select(key).where(F.col(key).isNotNull()).distinct()
    known = existing.select(key).join(candidates, key, "left_semi").distinct()
    return batch.join(known, key, "left_anti").select(*incoming.columns)
