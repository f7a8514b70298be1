"""Rows as blocks of numpy arrays that stay with the executors over many passes.

For fits that read the same rows hundreds of times: a pass is one job without a plan to make
and without code to compile, and only sums of a fixed size come back. Where the passes are
thousands, even that is too much, and one stage holds the rows for all of them (``together``).
"""

from __future__ import annotations

import os
import pickle
import struct
import tempfile
import time
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD, BarrierTaskContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from demandlake.session import scratch_path, scratch_root

# Partitions whose sums are added by the driver itself; those of more are added by tasks first.
DIRECT = 64


class Sums(tuple):
    """Arrays or numbers that are added place by place."""

    def __add__(self, other: Sums) -> Sums:
        return Sums(map(add, self, other))


def packed(df: DataFrame, pack: Callable[[pa.RecordBatch], Any]) -> DataFrame:
    """What ``pack`` makes of each Arrow batch of ``df``, a row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(pack(batch), 5)], pa.binary())], names=["block"])

    return df.mapInArrow(rows, "block binary")


def numpy_blocks(
    df: DataFrame, pack: Callable[[pa.RecordBatch], Any], join: Callable[[Iterator[Any]], Iterator[Any]] = iter
) -> RDD:
    """What ``pack`` makes of each Arrow batch of ``df``, and ``join`` of those of a partition,
    kept; unpersist it at the end.

    A table of a few files is dealt to all cores first, for every later pass gains by it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    blocks = packed(df, pack).rdd.mapPartitions(lambda rows: join(pickle.loads(row["block"]) for row in rows))
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def summed(blocks: RDD, sums: Callable[[Any], Sums]) -> Sums:
    """``sums`` of every block, added up; there must be a block."""

    def of_partition(part: Iterator[Any]) -> Iterator[Sums]:
        total = None
        for block in part:
            total = sums(block) if total is None else total + sums(block)
        if total is not None:
            yield total

    found = blocks.mapPartitions(of_partition)
    return reduce(add, found.collect()) if found.getNumPartitions() <= DIRECT else found.treeReduce(add)


# --- Tasks side by side ----------------------------------------------------------


def _shared(path: str, spark: SparkSession) -> str | None:
    """A path below the scratch root as tasks may open it; None where only Spark can."""
    scheme, _, rest = path.partition(":") if "://" in path or path.startswith("file:") else ("", "", path)
    if not scheme:
        scheme = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").partition(":")[0]
    return "/" + rest.lstrip("/") if scheme == "file" else None


def side_by_side(spark: SparkSession, wanted: int) -> int:
    """How many of the wanted tasks can run at the same time and see each other's files, at most
    ``DIRECT``; 0 where tasks cannot be held together."""
    context = spark.sparkContext
    if wanted <= 1:
        return 1
    if context.getConf().get("spark.dynamicAllocation.enabled", "false") == "true" or not _shared(scratch_root(spark), spark):
        return 0
    scala = context._jsc.sc()
    slots = scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile())
    return min(wanted, slots, DIRECT)


def in_file(array: np.ndarray) -> np.ndarray:
    """The array in a file of the task's own, which goes with it."""
    if not array.size:
        return array
    with tempfile.TemporaryFile() as file:
        held = np.memmap(file, array.dtype, "w+", shape=array.shape)
    held[:] = array
    return held


class _Exchange:
    """Sums of all tasks of a stage, handed over in files that are written over and over.

    A task is at most one turn ahead of the others, for it needs their sums to go on, so two
    files a task are enough. A file that is still being written is told by its checksum.
    Spark's own ``allGather`` answers once a second.
    """

    #: Seconds in which the first files of the others must be seen, and between two looks.
    PATIENCE, LEAST_WAIT, MOST_WAIT = 120, 0.0002, 0.002
    _HEAD = struct.Struct("<qqI")

    def __init__(self, folder: str, task: int, tasks: int) -> None:
        self.folder, self.task, self.tasks, self.turn = folder, task, tasks, 0
        os.makedirs(folder, exist_ok=True)

    def _file(self, task: int) -> str:
        return f"{self.folder}/{task}-{self.turn % 2}"

    def _write(self, sums: Sums | None) -> None:
        held = pickle.dumps(sums, 5)
        # Not cut to nothing first, nor put in place of the old one: file systems write that to disk.
        file = os.open(self._file(self.task), os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            rest = memoryview(self._HEAD.pack(self.turn, len(held), zlib.crc32(held)) + held)
            while rest:
                rest = rest[os.write(file, rest):]
        finally:
            os.close(file)

    def _look(self, task: int) -> bytes | None:
        """What a task wrote in this turn; None while it has not."""
        try:
            with open(self._file(task), "rb") as file:
                head = file.read(self._HEAD.size)
                if len(head) < self._HEAD.size:
                    return None
                turn, size, check = self._HEAD.unpack(head)
                if turn != self.turn:
                    return None
                held = file.read(size)
        except FileNotFoundError:
            return None
        return held if zlib.crc32(held) == check else None

    def _read(self, task: int) -> Sums | None:
        began, wait = time.monotonic(), self.LEAST_WAIT
        while (held := self._look(task)) is None:
            if not self.turn and time.monotonic() - began > self.PATIENCE:
                raise RuntimeError(f"not every executor sees the files of the others in {self.folder}")
            time.sleep(wait)
            wait = min(wait * 1.2, self.MOST_WAIT)
        return pickle.loads(held)

    def __call__(self, sums: Sums | None) -> Sums:
        self._write(sums)
        found = [sums if task == self.task else self._read(task) for task in range(self.tasks)]
        self.turn += 1
        return reduce(add, [s for s in found if s is not None])


def together(
    blocks: DataFrame, tasks: int, work: Callable[[Iterator[Any], Callable[[Sums | None], Sums]], Any]
) -> Any:
    """``work`` of packed blocks in tasks that run side by side: each gets its blocks and a call
    that adds the sums of all. All return the same; if one is lost, all begin again."""
    folder = _shared(scratch_path(blocks.sparkSession, "sums"), blocks.sparkSession)

    def run(rows: Iterator[Any]) -> Iterator[Any]:
        held = (pickle.loads(row["block"]) for row in rows)
        if tasks == 1:
            return iter([work(held, lambda sums: sums)])
        context = BarrierTaskContext.get()
        # Of this attempt alone, so that no file of another one is taken for its own.
        name = context.allGather(str(context.taskAttemptId()))[0]
        found = work(held, _Exchange(f"{folder}/{name}", context.partitionId(), tasks))
        return iter([] if context.partitionId() else [found])

    dealt = blocks.repartition(tasks).rdd
    return (dealt.barrier() if tasks > 1 else dealt).mapPartitions(run).collect()[0]
