"""Raw posting files: RFC 4180 CSV with a header, all columns text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from demandlake import schemas

# Quotes are doubled inside quoted fields; fields may hold commas and newlines.
DIALECT = {"header": True, "quote": '"', "escape": '"'}
# Stands for NULL in our own exports, so that a blank text stays a blank.
NULL_MARKER = "\\N"
# How exports are written and read back unchanged.
EXPORT = {
    **DIALECT, "nullValue": NULL_MARKER, "multiLine": True,
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_postings_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    null_marker: str | None = None,
) -> DataFrame:
    """Scan posting files as text columns.

    With ``columns`` the files must have exactly that header and no file is
    opened while planning. Without, the names come from the first header line.
    A crawled file has no mark for NULL and its blanks read as NULL; files of ``write_csv``
    are read back unchanged with ``null_marker=NULL_MARKER``. A multi-line file cannot be
    split: crawls are expected as many files of bounded size.
    """
    reader = spark.read.options(**DIALECT, multiLine=True, encoding="UTF-8")
    if null_marker is not None:
        reader = reader.options(nullValue=null_marker, emptyValue="")
    if columns is not None:
        reader = reader.schema(schemas.text_columns(columns)).option("enforceSchema", False)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a directory of CSV part files, NULL as ``NULL_MARKER``.

    The rebalance lets adaptive execution size the files: a small export ends in
    one file, a large one in as many as its bytes need.
    """
    df.hint("rebalance").write.options(**EXPORT).mode(mode).csv(path)
