"""Tables that are replaced without ever being missing.

A build writes each table under a name of its own; one appended file of a small log then makes
all of them current at once. Readers meet views, which are pointed to the current tables, or
take a snapshot of one version from the log. A build that fails leaves the log, and so every
reader, where it was.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from demandlake.sources.catalog import LoadAudit, by_partition

LOG = "publications"
_OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"
_LOG_SCHEMA = (
    "version bigint, build string, entries int, name string, target string, committed_at timestamp"
)
_TARGET = re.compile(r"(?P<name>.+)__v(?P<version>\d+)_[0-9a-f]{8}")


class PublishConflict(RuntimeError):
    """Another build has taken the version first; this one is not current."""


class Publications:
    """The published tables of a namespace. The last ``keep`` versions stay readable."""

    def __init__(self, spark: SparkSession, namespace: str, keep: int = 2):
        self.spark, self.namespace, self.keep = spark, namespace, keep
        self._log = f"{namespace}.{LOG}"

    # --- Reading -----------------------------------------------------------

    def _versions(self) -> DataFrame:
        """The log's whole entries of the winning build of each version: a build whose file
        is not all there is none, and of two that took one version the least name wins."""
        self.spark.catalog.refreshTable(self._log)
        log = self.spark.table(self._log)
        builds = log.groupBy("version", "build").agg(
            F.count(F.lit(1)).alias("held"), F.max("entries").alias("entries")
        ).where("held = entries")
        winners = builds.groupBy("version").agg(F.min("build").alias("build"))
        return log.join(winners, ["version", "build"])

    def _entries(self) -> dict[int, dict[str, str]]:
        """The targets by name of the last ``keep`` versions."""
        if not self.spark.catalog.tableExists(self._log):
            return {}
        log = self._versions()
        last = log.agg(F.max("version")).first()[0] or 0
        found: dict[int, dict[str, str]] = {}
        for r in log.where(F.col("version") > last - self.keep).collect():
            found.setdefault(r["version"], {})[r["name"]] = r["target"]
        return found

    def version(self) -> int:
        """The current version; 0 before the first."""
        return max(self._entries(), default=0)

    def current(self) -> dict[str, str]:
        """The tables that hold the current version, by name."""
        entries = self._entries()
        return entries[max(entries)] if entries else {}

    def snapshot(self) -> dict[str, DataFrame]:
        """All tables of the current version; a publication in between changes none of them."""
        return {name: self.spark.table(self._full(target)) for name, target in self.current().items()}

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._full(self.current()[name]))

    def _full(self, target: str) -> str:
        return f"{self.namespace}.{target}"

    # --- Writing -----------------------------------------------------------

    def publish(
        self,
        frames: Mapping[str, DataFrame],
        partition_by: Mapping[str, Sequence[str]] | None = None,
        format: str | None = None,
        options: Mapping[str, str] | None = None,
    ) -> list[LoadAudit]:
        """Replace the named tables together; the others of the namespace stay current.

        The frames may read what they replace. On a failure nothing changes and the tables
        written so far are dropped.
        """
        before = self.version()
        build = uuid.uuid4().hex[:8]
        targets = {name: f"{name}__v{before + 1}_{build}" for name in frames}
        audits = []
        try:
            for name, df in frames.items():
                columns = tuple((partition_by or {}).get(name, ()))
                audits.append(LoadAudit(
                    f"{self.namespace}.{name}", *[self._write(df, targets[name], columns, format, options)] * 2
                ))
            self._commit(before + 1, build, self.current() | targets)
        except BaseException:
            for target in targets.values():
                self.spark.sql(f"DROP TABLE IF EXISTS {self._full(target)}")
            raise
        self.point_views()
        self.vacuum()
        return audits

    def _write(self, df: DataFrame, target: str, columns, format, options) -> int:
        seen = Observation()
        rows = df.observe(seen, F.count(F.lit(1)).alias("added"))
        writer = (by_partition(rows, columns) if columns else rows).write.options(**(options or {}))
        writer.partitionBy(*columns).saveAsTable(self._full(target), format=format, mode="errorifexists")
        return seen.get["added"]

    def _commit(self, version: int, build: str, targets: Mapping[str, str]) -> None:
        rows = [(version, build, len(targets), n, t) for n, t in sorted(targets.items())]
        log = self.spark.createDataFrame(rows, "version long, build string, entries int, name string, target string")
        log = log.withColumn("committed_at", F.current_timestamp()).coalesce(1)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._log} ({_LOG_SCHEMA}) USING parquet")
        log.write.mode("append").saveAsTable(self._log, format="parquet")
        winner = self._versions().where(F.col("version") == version).agg(F.min("build")).first()[0]
        if winner != build:
            raise PublishConflict(f"version {version} of {self.namespace} is build {winner}, not {build}")

    def refresh_partitions(self, name: str, df: DataFrame) -> LoadAudit:
        """Replace the partitions of a published table that ``df`` has rows of, in place; the
        files of all others stay. ``df`` is computed whole before any partition changes."""
        target = self._full(self.current()[name])
        seen = Observation()
        columns = [c.name for c in self.spark.catalog.listColumns(target) if c.isPartition]
        rows = df.observe(seen, F.count(F.lit(1)).alias("added"))
        rows = by_partition(rows, columns).select(*self.spark.table(target).columns)
        # An insert into a catalogued table heeds the session's mode and not the writer's.
        before = self.spark.conf.get(_OVERWRITE_MODE)
        self.spark.conf.set(_OVERWRITE_MODE, "dynamic")
        try:
            rows.write.insertInto(target, overwrite=True)
        finally:
            self.spark.conf.set(_OVERWRITE_MODE, before)
        return LoadAudit(f"{self.namespace}.{name}", seen.get["added"], self.spark.table(target).count())

    def point_views(self) -> None:
        """Point the views to the current version; each of them always has one. Run again
        after a crash, this ends what the crash cut short."""
        listed = self.spark.catalog.listTables(self.namespace)
        tables = {t.name: t.tableType for t in listed if not t.isTemporary}
        for name, target in self.current().items():
            view = self._full(name)
            if name in tables and tables[name] != "VIEW":
                # A table of before its first publication.
                self.spark.sql(f"ALTER TABLE {view} RENAME TO {self._full(f'{name}__v0_00000000')}")
            verb = "ALTER VIEW" if tables.get(name) == "VIEW" else "CREATE VIEW"
            self.spark.sql(f"{verb} {view} AS SELECT * FROM {self._full(target)}")

    def vacuum(self) -> list[str]:
        """Drop versions that are out of reach, those of failed builds too. Tables of a later
        version belong to a build that is going on."""
        entries = self._entries()
        held = {target for targets in entries.values() for target in targets.values()}
        dropped = []
        for t in self.spark.catalog.listTables(self.namespace):
            match = _TARGET.fullmatch(t.name)
            if match and t.name not in held and int(match["version"]) <= max(entries, default=-1):
                self.spark.sql(f"DROP TABLE IF EXISTS {self._full(t.name)}")
                dropped.append(t.name)
        return dropped


def is_version(name: str) -> bool:
    """Whether a table holds a version of another, or the log of versions."""
    return name == LOG or _TARGET.fullmatch(name) is not None
