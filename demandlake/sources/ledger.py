"""The ledger of runs: which steps of a chain are done, and what each load added.

A chain names its run, such as by the day it is for. Started again under that name, it leaves
out the steps that are done and goes on at the first that is not; their audits come from the
ledger. Every entry is one appended row, so a killed run leaves whole entries only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.sources.catalog import LoadAudit

STARTED, DONE, FAILED = "started", "done", "failed"
_AUDITS = "array<struct<table:string,added:bigint,total:bigint>>"
_SCHEMA = f"run string, chain string, step string, state string, note string, audits {_AUDITS}"


class RunLedger:
    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table

    def write(self, run: str, chain: str, step: str, state: str, note: str = "", audits: Sequence[LoadAudit] = ()):
        if not self.spark.catalog.tableExists(self.table):
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({_SCHEMA}, at timestamp) USING parquet")
        row = (run, chain, step, state, note, [tuple(a) for a in audits])
        entry = self.spark.createDataFrame([row], _SCHEMA).withColumn("at", F.current_timestamp())
        entry.coalesce(1).write.mode("append").saveAsTable(self.table, format="parquet")

    def entries(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def done(self, run: str, chain: str) -> dict[str, list[LoadAudit]]:
        """The audits of the steps that are done in a run of a chain."""
        if not self.spark.catalog.tableExists(self.table):
            return {}
        mine = self.entries().where((F.col("run") == run) & (F.col("chain") == chain) & (F.col("state") == DONE))
        return {r["step"]: [LoadAudit(*a) for a in r["audits"]] for r in mine.orderBy("at").collect()}

    def audits(self) -> DataFrame:
        """One row per load of every finished step, with the rows it added and left."""
        return self.entries().where(F.col("state") == DONE).select(
            "run", "chain", "step", "at", F.inline("audits")
        )

    def states(self) -> DataFrame:
        """The last state of each step of each run."""
        last = F.max_by(F.struct("state", "note", "at"), F.struct("at", F.col("state") != STARTED))
        return self.entries().groupBy("run", "chain", "step").agg(last.alias("last")).select(
            "run", "chain", "step", "last.*"
        )

    def open(self, chain: str, run: str | None = None) -> Run:
        return Run(self, chain, run or uuid.uuid4().hex)


class Run:
    """One run of a chain: steps in their order."""

    def __init__(self, ledger: RunLedger, chain: str, run: str):
        self._ledger, self.chain, self.run = ledger, chain, run
        self._done = ledger.done(run, chain)

    def step(self, name: str, work: Callable[[], Sequence[LoadAudit]]) -> list[LoadAudit]:
        """Do a step unless this run has done it; a step must bear to be done again, for it
        may be killed after its work and before its entry."""
        if name in self._done:
            return self._done[name]
        self._ledger.write(self.run, self.chain, name, STARTED)
        try:
            audits = list(work())
        except Exception as error:
            self._ledger.write(self.run, self.chain, name, FAILED, f"{type(error).__name__}: {error}"[:1000])
            raise
        self._ledger.write(self.run, self.chain, name, DONE, audits=audits)
        self._done[name] = audits
        return audits
