"""Reading the given tables and cutting lineage in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.session import scratch_path

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, its size known."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


# Bits of the map of wanted keys, whatever their number: 8 MB in all.
_MAP_BITS = 1 << 26


def only_keys(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among those of ``wanted``, before a join settles it.

    Keys are marked in a map of bits of a fixed size, of which at most 1,048,576 rows of a
    word and its bits are sent to all tasks. Where wanted keys are few, few others pass; were
    they so many that the map is full, all rows pass and the join does the work.
    """
    place = F.pmod(F.xxhash64(key), F.lit(_MAP_BITS))
    word = F.shiftright(place, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    marked = wanted.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(
        F.bit_or("__bit").alias("__bits")
    )
    marked = stage(marked, "wanted-bits")
    found = df.join(F.broadcast(marked), word == F.col("__word")).filter(F.col("__bits").bitwiseAND(bit) != 0)
    return found.select(*df.columns)
