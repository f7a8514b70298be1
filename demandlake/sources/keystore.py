"""The keys a table holds, bucketed and sorted, so that a batch finds its new rows without
moving them.

The store is a narrow table of the distinct keys, in a fixed number of buckets. A batch is
dealt to the same buckets; the stored side of the join is read where it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Each load adds a file to a bucket; beyond so many loads the store is written anew.
MOST_LOADS = 32


class KeyStore:
    """``buckets`` counts when the store is made; without, it gets the session's number of
    shuffle partitions, and a batch is joined by that many tasks from then on."""

    def __init__(self, spark: SparkSession, table: str, key: str, buckets: int | None = None):
        self.spark, self.table, self.key, self._asked = spark, table, key, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def buckets(self) -> int:
        if self.exists():
            facts = self.spark.sql(f"DESCRIBE EXTENDED {self.table}").where("col_name = 'Num Buckets'").first()
            return int(facts["data_type"])
        return self._asked or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def keys(self) -> DataFrame:
        return self.spark.table(self.table).select(self.key)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose key is not stored; null keys are dropped."""
        rows = batch.where(F.col(self.key).isNotNull())
        if not self.exists():
            return rows
        return rows.join(self.keys(), self.key, "left_anti").select(*batch.columns)

    def add(self, keys: DataFrame) -> None:
        """Append keys that the store does not hold; they must be distinct."""
        self._write(keys.select(self.key).withColumn("load", F.lit(self._loads())), "append")

    def _loads(self) -> int:
        """How many loads the store has files of."""
        last = self.spark.table(self.table).agg(F.max("load")).first()[0] if self.exists() else None
        return 0 if last is None else last + 1

    def _write(self, rows: DataFrame, mode: str, table: str | None = None) -> None:
        buckets = self.buckets()
        dealt = rows.repartition(buckets, self.key)
        dealt.write.mode(mode).bucketBy(buckets, self.key).sortBy(self.key).saveAsTable(
            table or self.table, format="parquet"
        )

    def sync(self, holder: DataFrame) -> int:
        """Bring the store in line with the table whose keys it holds, and say how many keys
        it lacked. Rows are added to the table first, so a load that was cut short leaves keys
        out; the counts, read from file footers, tell. ``holder`` has each key once."""
        held = self.keys().count() if self.exists() else 0
        missing = holder.count() - held
        if missing:
            self.add(self.unseen(holder.select(self.key)))
        return missing

    def compact(self) -> bool:
        """Write the store anew, a file per bucket, once it has many loads."""
        if self._loads() <= MOST_LOADS:
            return False
        fresh = f"{self.table}_compact"
        self.spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        self._write(self.keys().withColumn("load", F.lit(0)), "errorifexists", fresh)
        self.spark.sql(f"DROP TABLE {self.table}")
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.table}")
        return True
