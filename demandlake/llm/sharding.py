"""Sharding by rendezvous hashing of a stable key over weighted shards.

Every key draws one number per shard from a hash of key and shard; the shard with the
highest ``-weight / ln(draw)`` takes it. A draw depends on nothing but the key and the
shard, so a further shard takes keys only into itself, in proportion to its weight.

Only DataFrame functions are used. Rows are narrowed to key, size and checksum at the
scan; equal narrow rows are counted before the shuffle, so neither a hot key nor a group
of repeated rows meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandlake.llm.tables import stage, table, text_or_empty

SHARDS = 16
# Slots are numbered inside so many hash buckets of a shard, each a sort of its own.
BUCKETS = 4096
_DRAW_DIGITS = 13


def _draw(key: Column, label: int | str) -> Column:
    """A number in (0, 1) that key and label decide."""
    digest = F.md5(F.concat(key, F.lit(f":{label}")))
    top = F.conv(F.substring(digest, 1, _DRAW_DIGITS), 16, 10).cast("long")
    return (top + 1) / F.lit(float(16**_DRAW_DIGITS + 1))


def _score(key: Column, shard: int, weight: float) -> Column:
    return F.lit(-float(weight)) / F.log(_draw(key, shard))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key`` (a string column); equal scores go to the higher shard."""
    scored = [
        F.struct(_score(key, i, w).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return F.array_max(F.array(*scored))["shard"]


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    weights: Sequence[float] | None = None,
    key: str = "doc_id",
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per document: its shard, its slot there, and its shard with one more.

    A null key counts as the empty key and a null text as none; repeated rows keep a slot
    each; an empty table gives an empty result. Columns beyond key and text are ignored.
    ``weights`` has one more entry than ``shards``: the last is that of the added shard.
    """
    weights = list(weights or [1.0] * (shards + 1))
    text = F.col("text")
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"),
    ).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    bucket = F.floor(
        _draw(F.concat_ws("|", name, F.col("size"), F.col("text_crc32")), "slot") * buckets
    )
    placed = stage(
        narrow.withColumns({
            "shard": rendezvous(name, weights[:shards]).cast("int"),
            "grown_shard": rendezvous(name, weights).cast("int"),
            "bucket": bucket.cast("int"),
        }),
        "shards",
    )
    by_shard = Window.partitionBy("shard").orderBy("bucket")
    before_bucket = (
        placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("held"))
        .select("shard", "bucket", (F.sum("held").over(by_shard) - F.col("held")).alias("base"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    # At most shards * buckets rows, whatever the input.
    numbered = placed.join(F.broadcast(before_bucket), ["shard", "bucket"]).withColumn(
        "first", F.col("base") + F.sum("copies").over(inside) - F.col("copies")
    )
    return numbered.select(
        "doc_id", "size", "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("slot"),
        "grown_shard",
    )


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
