"""Repeated word runs across documents, by fixed-block anchors.

The reference blocks of a document are its words cut into blocks of ``BLOCK``; every rolling
window of ``BLOCK`` words is a probe. A run of ``WINDOW`` words holds ``RUN`` whole reference
blocks wherever it lies, so it is enough to index the block of least hash of each ``RUN``
neighbouring blocks, and to probe, of each ``RUN`` windows that many words apart, the one of
least hash: where two documents share a run, they pick the same block of it. This is exact
and sends about a quarter of the windows. Hits are then extended: all windows of ``WINDOW``
words that a hit can belong to are compared with the others' by a 64-bit hash of all their
words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import text as T
from demandlake.llm.tables import only_keys, stage, table

WINDOW = 50
BLOCK = 6
# Whole blocks in any run of WINDOW words: the first may begin BLOCK - 1 words late.
RUN = (WINDOW - BLOCK + 1) // BLOCK


def anchors(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a run, given the hashes of a text's rolling windows: the window that
    the run picks. Runs whose start is a multiple of ``BLOCK`` pick reference blocks."""
    n = len(blocks) - (RUN - 1) * BLOCK
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.arange(n)
    picked, least = starts.copy(), blocks[:n].copy()
    for i in range(1, RUN):
        other = blocks[i * BLOCK:i * BLOCK + n]
        lower = other < least
        least = np.where(lower, other, least)
        picked = np.where(lower, starts + i * BLOCK, picked)
    return starts, picked


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, T.Spans, int, int]]:
    """Row, bytes, words and first and end word of each text of a batch."""
    for first, end, data, offsets in T.chunks(batch.column("text")):
        words = T.words(data, offsets)
        for i in range(end - first):
            yield first + i, data, words, int(words.first[i]), int(words.first[i + 1])


def _windows(words: T.Spans, first: int, end: int, n: int, whole: T.RangeHash) -> np.ndarray:
    at = np.arange(first, end - n + 1)
    return whole(at, at + n)


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("doc_id")
        named = keys.is_valid().to_pylist()
        last, whole, found = None, None, []
        for row, _, words, first, end in _texts(batch):
            if not named[row] or end - first < WINDOW:
                continue
            if words is not last:
                last, whole = words, T.RangeHash(words.hashes)
            blocks = _windows(words, first, end, BLOCK, whole)
            starts, picked = anchors(blocks)
            reference = np.zeros(len(blocks), bool)
            reference[picked[starts % BLOCK == 0]] = True
            chosen = np.zeros(len(blocks), bool)
            chosen[picked] = True
            at = np.flatnonzero(chosen)
            found.append((row, blocks[at], reference[at]))
            if len(found) >= 500:
                yield _anchor_batch(keys, found)
                found = []
        if found:
            yield _anchor_batch(keys, found)


def _anchor_batch(keys: pa.Array, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    rows, hashes, references = zip(*found)
    owners = np.repeat(rows, [len(h) for h in hashes])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(hashes).view(np.int64)), keys.take(pa.array(owners)),
            pa.array(np.concatenate(references)),
        ],
        names=["hash", "doc_id", "reference"],
    )


def _extend_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with hits keep their text and the hashes of the windows to compare; all others
    get their result."""
    for batch in batches:
        hits = batch.column("hits").to_pylist()
        out: dict[str, list] = {"n_words": [], "sha": [], "text": [], "windows": []}
        texts = batch.column("text")
        last, whole = None, None
        for row, data, words, first, end in _texts(batch):
            if words is not last:
                last, whole = words, T.RangeHash(words.hashes)
            windows = np.zeros(0, np.uint64)
            if hits[row] and end - first >= WINDOW:
                blocks = _windows(words, first, end, BLOCK, whole)
                starts, picked = anchors(blocks)
                hit = np.isin(blocks, np.array(hits[row], np.int64).view(np.uint64))
                # A window's run begins at one of its first BLOCK words.
                runs = hit[picked]
                near = np.zeros(end - first - WINDOW + 1, bool)
                for late in range(BLOCK):
                    part = runs[late:late + len(near)]
                    near[:len(part)] |= part
                at = np.flatnonzero(near) + first
                windows = np.unique(whole(at, at + WINDOW))
            out["n_words"].append(end - first)
            if len(windows):
                out["sha"].append(None)
                out["text"].append(texts[row].as_py())
                out["windows"].append(windows.view(np.int64))
            else:
                kept = _joined(data, words, np.arange(first, end))
                out["sha"].append(hashlib.sha256(kept).hexdigest())
                out["text"].append(None)
                out["windows"].append(None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(out["n_words"], pa.int64()),
                pa.array(out["sha"], pa.string()), pa.array(out["text"], pa.string()),
                pa.array(out["windows"], pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_words", "sha", "text", "windows"],
        )


def _joined(data: np.ndarray, words: T.Spans, kept: np.ndarray) -> bytes:
    """The given words of a run of texts, joined by spaces."""
    if not len(kept):
        return b""
    base = int(words.starts[kept[0]])
    raw = data[base:words.ends[kept[-1]]].tobytes()
    bounds = zip((words.starts[kept] - base).tolist(), (words.ends[kept] - base).tolist())
    return b" ".join([raw[start:end] for start, end in bounds])


def _remove_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = batch.column("gone").to_pylist()
        removed, shas, texts = [], [], []
        last, whole = None, None
        for row, data, words, first, end in _texts(batch):
            if words is not last:
                last, whole = words, T.RangeHash(words.hashes)
            flags = np.zeros(end - first, bool)
            if gone[row] and end - first >= WINDOW:
                hashes = _windows(words, first, end, WINDOW, whole)
                starts = np.flatnonzero(np.isin(hashes, np.array(gone[row], np.int64).view(np.uint64)))
                flags = T.covered(end - first, starts, WINDOW)
            kept = np.flatnonzero(~flags) + first
            removed.append(int(flags.sum()))
            encoded = _joined(data, words, kept)
            shas.append(hashlib.sha256(encoded).hexdigest())
            texts.append(encoded.decode())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()),
                pa.array(shas, pa.string()), pa.array(texts, pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: its words, how many a smaller document has in a run of ``WINDOW``
    words, the hash of the others joined by spaces, and ``kept_text``, those words, where
    any were removed (null: none were).

    Keys are of any type that has an order, and are compared by it. A null text has no
    words; a null key is neither removed from nor a reference; rows of one key are not
    smaller than each other; an empty table gives an empty result; columns other than key and
    text are ignored.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", "text")
    rows = narrow.mapInArrow(_anchor_batches, f"hash long, doc_id {key}, reference boolean")
    # Aggregated before it is moved, so a block of very many documents is one row a task.
    shared = rows.groupBy("hash").agg(
        F.min(F.when(F.col("reference"), F.col("doc_id"))).alias("least"), F.max("doc_id").alias("most")
    )
    shared = stage(shared.filter("least < most"), "shared-blocks")
    hits = (
        only_keys(rows, "hash", shared).join(shared, "hash")
        .filter(
            (F.col("doc_id") > F.col("least")) | (F.col("reference") & (F.col("doc_id") < F.col("most")))
        )
        .groupBy("doc_id").agg(F.collect_set("hash").alias("hits"))
    )
    hits = stage(hits, "anchor-hits")
    extended = narrow.join(hits, "doc_id", "left").mapInArrow(
        _extend_batches,
        f"doc_id {key}, n_words long, sha string, text string, windows array<long>",
    )
    extended = stage(extended, "extended")
    windows = extended.select("doc_id", F.explode("windows").alias("hash"))
    least = windows.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = stage(least.filter("least < most").select("hash", "least"), "shared-windows")
    gone = (
        only_keys(windows, "hash", least).join(least, "hash").filter("doc_id > least")
        .groupBy("doc_id").agg(F.collect_set("hash").alias("gone"))
    )
    plain = extended.filter("sha IS NOT NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"),
        F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"),
    )
    cut = extended.filter("sha IS NULL").select("doc_id", "n_words", "text").join(
        gone, "doc_id", "left"
    ).mapInArrow(
        _remove_batches,
        f"doc_id {key}, n_words long, n_removed long, kept_sha256 string, kept_text string",
    )
    return plain.union(cut)


def op2_fixed_block_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
