"""Packing of documents into sequences by cutting-stock column generation.

Documents are cut into pieces of at most one sequence; full pieces stand alone. The rest
are counted by length class, and the histogram, whose size does not depend on the data, is
all that the driver sees: a linear program over patterns (how many pieces of each class
share a sequence) is solved by column generation, where a knapsack dynamic program prices
new patterns. Rounded-down pattern counts and a first-fit of the few pieces left over give
a plan of rank ranges, and every piece finds its sequence from its rank in its class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandlake.llm.tables import stage, table
from demandlake.llm.tokens import TOKENIZER_FILE, encode_texts, tokenizer_path

SEQUENCE = 2048
# Lengths are rounded up to a multiple of this many tokens for the linear program.
GRAIN = 8
# Columns are added until none can save a thousandth of the sequences, or so many were.
TOLERANCE = 1e-3
MOST_COLUMNS = 2000


def price_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of most value; item ``i`` weighs ``i + 1``."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        n = min(room, len(values))
        gains = values[:n] + best[room - 1::-1][:n]
        i = int(np.argmax(gains))
        best[room] = best[room - 1]
        if gains[i] > best[room]:
            best[room], took[room] = gains[i], i + 1
    pattern = np.zeros(len(values), np.int64)
    room = capacity
    while room > 0:
        if took[room]:
            pattern[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[capacity]), pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchanges; one thread, and the same result on any machine."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        pivot = i + int(np.argmax(np.abs(work[i:, i])))
        work[[i, pivot]] = work[[pivot, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, n:]


def solve_patterns(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their fractional counts, covering ``demand`` with the fewest sequences.

    A revised simplex: the basis starts with one pattern per class, and each step brings in
    the pattern that the dual prices value most.
    """
    classes = np.flatnonzero(demand)
    if not len(classes):
        return np.zeros((0, len(demand)), np.int64), np.zeros(0)
    m = len(classes)
    basis = np.zeros((m, m))
    for row, c in enumerate(classes):
        basis[row, row] = capacity // (c + 1)
    inverse = np.diag(1 / np.diag(basis))
    amounts = _times(inverse, demand[classes])
    for step in range(MOST_COLUMNS):
        duals = inverse.sum(axis=0)
        values = np.zeros(len(demand))
        values[classes] = np.maximum(duals, 0)
        value, pattern = price_pattern(values, capacity)
        if value <= 1 + TOLERANCE:
            break
        column = _times(inverse, pattern[classes])
        usable = column > 1e-9
        if not usable.any():
            break
        ratios = np.where(usable, amounts / np.where(usable, column, 1), np.inf)
        out = int(np.argmin(ratios))
        basis[:, out] = pattern[classes]
        if step % 200 == 199:
            inverse = _inverse(basis)
            amounts = np.maximum(_times(inverse, demand[classes]), 0)
        else:
            enter = ratios[out]
            amounts = np.maximum(amounts - enter * column, 0)
            amounts[out] = enter
            pivot = inverse[out] / column[out]
            inverse -= column[:, None] * pivot
            inverse[out] = pivot
    patterns = np.zeros((m, len(demand)), np.int64)
    patterns[:, classes] = np.rint(basis.T).astype(np.int64)
    return patterns, amounts


@dataclass
class Plan:
    """Rank ranges: ranks from ``rank`` of a class fill the sequences from ``sequence``,
    ``per`` of them in each, ``slot`` orders the classes inside a sequence."""

    bounds: list[tuple[int, int, int, int, int]]  # class, rank, sequence, per, slot
    sequences: int


def make_plan(demand: np.ndarray, capacity: int) -> Plan:
    """A placement of all pieces counted in ``demand`` (by class, from weight 1)."""
    patterns, amounts = solve_patterns(demand, capacity)
    left = demand.astype(np.int64).copy()
    rank = np.zeros(len(demand), np.int64)
    bounds: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(pattern: np.ndarray, times: int) -> None:
        nonlocal sequences
        for slot, c in enumerate(np.flatnonzero(pattern)):
            bounds.append((int(c), int(rank[c]), sequences, int(pattern[c]), slot))
        rank[:] += pattern * times
        left[:] -= pattern * times
        sequences += times

    for pattern, amount in zip(patterns, amounts):
        with np.errstate(divide="ignore"):
            most = np.where(pattern > 0, left // np.maximum(pattern, 1), np.iinfo(np.int64).max)
        times = int(min(np.floor(amount + 1e-6), most.min()))
        if times > 0:
            place(pattern, times)
    # At most one sequence per basis pattern is left over; fill them longest first.
    while left.any():
        pattern, room = np.zeros(len(demand), np.int64), capacity
        for c in range(len(demand) - 1, -1, -1):
            n = min(int(left[c]), room // (c + 1))
            pattern[c], room = n, room - n * (c + 1)
        place(pattern, int(min(left[c] // pattern[c] for c in np.flatnonzero(pattern))))
    return Plan(bounds, sequences)


def _piece_batches(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id")
            for first, ids, bounds in encode_texts(batch.column("text"), path):
                raw = memoryview(ids.astype("<u4")).cast("B")
                total = np.diff(bounds)
                pieces = (total + capacity - 1) // capacity
                text = np.repeat(np.arange(len(total)), pieces)
                start = (np.arange(len(text)) - (np.cumsum(pieces) - pieces)[text]) * capacity
                length = np.minimum(total[text] - start, capacity)
                at = bounds[text] + start
                crcs = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(text + first)), pa.array(start), pa.array(length),
                        pa.array(crcs, pa.int64()), pa.array(total[text]),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return cut


def token_pieces(docs: DataFrame, path: str, capacity: int = SEQUENCE) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, the end id counted."""
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _piece_batches(path, capacity),
        f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long",
    )


def _ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` (with ``class`` and the map task ``part``) and a gapless rank per class.

    A class may hold most of all rows: ranks are counted per class and map task, and only
    the counts are summed over a class.
    """
    counts = pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("held"))
    over = Window.partitionBy("class").orderBy("part")
    base = counts.select(
        "class", "part", (F.sum("held").over(over) - F.col("held")).alias("base")
    )
    inside = Window.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32")
    return pieces.join(base, ["class", "part"]).withColumn(
        "rank", F.col("base") + F.row_number().over(inside) - 1
    )


def _place_batches(plan: Plan):
    table_ = np.array(sorted(plan.bounds), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class = {}
        for c in np.unique(table_[:, 0]):
            by_class[int(c)] = table_[table_[:, 0] == c]
        for batch in batches:
            kind = batch.column("class").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, slot = np.empty(len(kind), np.int64), np.empty(len(kind), np.int64)
            for c in np.unique(kind):
                rows = np.flatnonzero(kind == c)
                mine = by_class[int(c)]
                at = np.searchsorted(mine[:, 1], rank[rows], "right") - 1
                step = rank[rows] - mine[at, 1]
                sequence[rows] = mine[at, 2] + step // mine[at, 3]
                slot[rows] = mine[at, 4] * SEQUENCE + step % mine[at, 3]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(slot)],
                names=[*names, "sequence_id", "slot"],
            )

    return place


def pack(docs: DataFrame, tokenizer: str = TOKENIZER_FILE, capacity: int = SEQUENCE) -> DataFrame:
    """One row per piece: where it starts in its document and where it lies.

    A null text is empty and has the end id alone; a null key stays null; repeated rows are
    packed each; an empty table gives an empty result; other columns are ignored.
    """
    path = tokenizer_path(tokenizer)
    pieces = token_pieces(docs, path, capacity).withColumns({
        "class": F.floor((F.col("length") + GRAIN - 1) / GRAIN).cast("int"),
        "part": F.spark_partition_id(),
    })
    pieces = stage(pieces, "token-pieces")
    classes = capacity // GRAIN
    demand = np.zeros(classes, np.int64)
    # One row per length class: capacity / GRAIN of them at most.
    for row in pieces.groupBy("class").count().collect():
        demand[row["class"] - 1] = row["count"]
    plan = make_plan(demand, classes)
    kind = pieces.schema["doc_id"].dataType.simpleString()
    ranked = _ranked(pieces).withColumn("class", F.col("class") - 1).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank"
    )
    placed = ranked.mapInArrow(
        _place_batches(plan),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, slot long",
    )
    inside = Window.partitionBy("sequence_id").orderBy("slot")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        (F.sum("length").over(inside) - F.col("length")).alias("offset"),
    )


def op4_column_generation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
