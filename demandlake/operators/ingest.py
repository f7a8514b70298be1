"""Raw files to bronze."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.operators.keyed import first_per_key, new_rows, total_order
from demandlake.sources.keystore import KeyStore

SOURCE = "ITviec"


def merge_raw(
    old: DataFrame, new: DataFrame, key: str = "job_link", order: Sequence[str] = ()
) -> DataFrame:
    """Old rows then new rows, the first of each key; a missing key counts as one key.

    Crawls may differ in their headers: the result has all columns, NULL where a crawl
    lacks one.
    """
    tagged = old.withColumn("__batch", F.lit(0)).unionByName(
        new.withColumn("__batch", F.lit(1)), allowMissingColumns=True
    )
    merged = tagged.drop("__batch")
    ranked = total_order(merged, order, [key])
    return first_per_key(tagged, [key], ["__batch", *ranked]).select(*merged.columns)


def stamp_bronze(raw: DataFrame, source: str = SOURCE) -> DataFrame:
    return raw.withColumns({"ingest_time": F.current_timestamp(), "source": F.lit(source)})


def unseen_rows(raw: DataFrame, store: KeyStore, order: Sequence[str] = ()) -> DataFrame:
    """Rows whose key a store of keys lacks, the first in ``order`` of each key."""
    fresh = store.unseen(raw)
    return first_per_key(fresh, [store.key], total_order(fresh, order, [store.key]))


def bronze_delta(raw: DataFrame, bronze: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Stamped rows to append to bronze: links it does not hold yet."""
    return stamp_bronze(new_rows(raw, bronze, "job_link", order))
