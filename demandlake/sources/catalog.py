"""Catalogued tables: namespaces, loads with an audit row, schema listing.

Tables go to the session catalog in the session's default format
(``spark.sql.sources.default``), so a configured lakehouse format is used as is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from demandlake.session import stage


class LoadAudit(NamedTuple):
    """What one load did: rows added and rows in the table afterwards."""

    table: str
    added: int
    total: int


def ensure_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{where}")


def load_table(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> LoadAudit:
    """Append ``df`` to ``table`` and report the counts; a missing table is created.

    On an existing table the delta is staged first, so its plan runs once although it is
    counted, skipped when empty and may read the table it goes to. Tables are replaced by
    ``publish.Publications``.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        delta = stage(df, "delta")
        before, added = spark.table(table).count(), delta.count()
        if added:
            _write(delta, table, "append", partition_by)
        return LoadAudit(table, added, before + added)
    seen = Observation()
    _write(df.observe(seen, F.count(F.lit(1)).alias("added")), table, "errorifexists", partition_by)
    added = seen.get["added"]
    return LoadAudit(table, added, added)


def _write(df: DataFrame, table: str, mode: str, partition_by: Sequence[str]) -> None:
    rows = by_partition(df, partition_by) if partition_by else df
    rows.write.mode(mode).partitionBy(*partition_by).saveAsTable(table)


def by_partition(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bring rows of one partition value together before a partitioned write.

    Rebalancing, unlike ``repartition``, splits a value that holds far more rows
    than the others over several tasks and files.
    """
    return df.hint("rebalance", *columns)


def describe_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns of every table with type and number of non-NULL values.

    One pass per table; the column list itself comes from the schema.
    """
    return reduce(DataFrame.unionByName, (_describe(n, df) for n, df in tables.items()))


def _describe(name: str, df: DataFrame) -> DataFrame:
    fields = list(enumerate(df.schema.fields, start=1))
    counts = df.agg(*[F.count(F.col(f.name)).alias(f"c{i}") for i, f in fields])
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("table_name"),
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"c{i}").alias("non_null"),
        )
        for i, f in fields
    ])
    return counts.select(F.inline(rows))
