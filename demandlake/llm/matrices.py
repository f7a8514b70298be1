"""Packed token-id matrices by best-fit-decreasing, with a segment tree over capacities.

Pieces are dealt by hash to groups of a bounded number of tokens, so packing needs one
shuffle of ids and no task holds more than a group. Inside a group pieces go, longest
first, to the open row with the least room that still fits; the segment tree over room
0..capacity finds it. Overlong documents are cut at multiples of the capacity, which loses
nothing: pieces name their start, and an unpacked matrix gives every document back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm.tables import stage, table
from demandlake.llm.text import mix
from demandlake.llm.tokens import TOKENIZER_FILE, encode_texts, tokenizer_path

CAPACITY = 2048
# Bytes of text per packing group; about twice as many bytes of ids.
GROUP_BYTES = 16 << 20
PAD_ID = 0


class RoomTree:
    """Which amounts of room have open rows: the least one of at least ``need``."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._count = [0] * (2 * self._leaves)
        self._rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, row: int) -> None:
        self._rows[room].append(row)
        self._add(room, 1)

    def pop(self, room: int) -> int:
        self._add(room, -1)
        return self._rows[room].pop()

    def _add(self, room: int, by: int) -> None:
        node = room + self._leaves
        while node:
            self._count[node] += by
            node >>= 1

    def least(self, need: int) -> int | None:
        count, node = self._count, need + self._leaves
        if count[node]:
            return need
        # Climb to the first subtree on the right that has rows, then go down its left edge.
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self._leaves:
                    node = 2 * node + (not count[2 * node])
                return node - self._leaves
            node >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The row of each piece; rows are numbered from 0 as they are opened."""
    row_of = np.empty(len(lengths), np.int64)
    tree, opened = RoomTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.least(need)
        if room is None:
            row, room, opened = opened, capacity, opened + 1
        else:
            row = tree.pop(room)
        row_of[i] = row
        tree.push(room - need, row)
    return row_of


_PIECE = "group long, doc_id {key}, start long, ids binary"
ROW_SCHEMA = (
    "group long, row long, n_tokens long, ids binary, doc_ids array<{key}>, starts array<long>, "
    "cu_seqlens array<int>, position_resets array<int>, ids_crc32 long"
)


def id_width(path: str) -> int:
    """Bytes of an id: two where the tokenizer's ids all fit, else four."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def _cut_batches(path: str, capacity: int, groups: int, width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column("doc_id")
            for first, ids, bounds in encode_texts(batch.column("text"), path):
                total = np.diff(bounds)
                pieces = (total + capacity - 1) // capacity
                text = np.repeat(np.arange(len(total)), pieces)
                start = (np.arange(len(text)) - (np.cumsum(pieces) - pieces)[text]) * capacity
                length = np.minimum(total[text] - start, capacity)
                # Dealt by place of the piece, so repeated documents spread as all others do.
                place = np.arange(seen, seen + len(text)).astype(np.uint64)
                group = mix(mix(place) ^ np.uint64(part)) % np.uint64(groups)
                seen += len(text)
                # Pieces follow each other in ids, and ids fill each text: one buffer serves.
                at = np.append(bounds[text] + start, bounds[-1]) * width
                data = pa.Array.from_buffers(
                    pa.large_binary(), len(text),
                    [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.astype(f"<u{width}"))],
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.astype(np.int64)), keys.take(pa.array(text + first)),
                     pa.array(start), data],
                    names=["group", "doc_id", "start", "ids"],
                )

    return cut


def _pack_group(capacity: int, width: int):
    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["doc_id", "start"], kind="stable")
        lengths = pieces["ids"].map(len).to_numpy() // width
        pieces = pieces.assign(row=best_fit_decreasing(lengths, capacity), n=lengths)
        out = []
        for row, mine in pieces.sort_values("row", kind="stable").groupby("row"):
            ends = np.cumsum(mine["n"].to_numpy())
            ids = b"".join(mine["ids"])
            wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
            out.append((
                int(mine["group"].iloc[0]), int(row), int(ends[-1]),
                ids + np.full(capacity - int(ends[-1]), PAD_ID, f"<u{width}").tobytes(),
                [None if pd.isna(k) else k for k in mine["doc_id"]], mine["start"].tolist(),
                [0, *ends.tolist()], [0, *ends[:-1].tolist()], zlib.crc32(wide.tobytes()),
            ))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ROW_SCHEMA.split(", ")])

    return pack


def packed_matrix(
    docs: DataFrame, tokenizer: str = TOKENIZER_FILE, capacity: int = CAPACITY,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per matrix row: little-endian ids padded to ``capacity``, of 16 bits or, where
    the tokenizer has greater ones, of 32; the document and start of each segment, cumulative
    segment lengths and where positions restart.

    A null text is empty and has the end id alone; a null key stays null; repeated rows are
    packed each; an empty table gives an empty result; other columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    groups = max(1, -(-size // group_bytes))
    key = docs.schema["doc_id"].dataType.simpleString()
    path = tokenizer_path(tokenizer)
    width = id_width(path)
    pieces = docs.select("doc_id", "text").mapInArrow(
        _cut_batches(path, capacity, groups, width), _PIECE.format(key=key)
    )
    # Written first: groups follow the order of rows, which may differ if a lost task is done
    # again after others have read from it.
    pieces = stage(pieces, "pieces")
    return pieces.repartition(groups, "group").groupBy("group").applyInPandas(
        _pack_group(capacity, width), ROW_SCHEMA.format(key=key)
    )


def unpack_matrix(matrix: DataFrame, width: int = 2) -> DataFrame:
    """Pieces ``(doc_id, start, ids)`` of a matrix of ids of ``width`` bytes, without padding."""
    at = F.posexplode("doc_ids").alias("i", "doc_id")
    pieces = matrix.select("ids", "starts", "cu_seqlens", at)
    first = F.element_at("cu_seqlens", F.col("i") + 1)
    n = F.element_at("cu_seqlens", F.col("i") + 2) - first
    return pieces.select(
        "doc_id", F.element_at("starts", F.col("i") + 1).alias("start"),
        F.substring("ids", first * width + 1, n * width).alias("ids"),
    )


def op10_best_fit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrix(table(spark, sf_dir, "documents"))
