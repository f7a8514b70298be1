"""Repeated byte strings within and across documents, by two-stage suffix sorting.

Every window of ``WINDOW`` bytes is filed under its anchor, the ``GRAM``-byte string of least
hash that it holds; equal windows have equal anchors, so only windows under an anchor that
occurs twice can repeat. Those windows are cut out as contexts (a stretch of text whose
windows share one anchor), equal contexts are counted once, and contexts meet by anchor.
Blocks of whole anchors are sorted as suffix arrays: suffixes smaller than their successor
are sorted directly, all others are induced by a scan over the buckets of first bytes, and
neighbours whose common prefix reaches ``WINDOW`` repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import text as T
from demandlake.llm.tables import stage, table, text_or_empty

WINDOW = 400
GRAM = 160
# Bytes of contexts sorted at a time; an anchor with more of them is sorted as one.
BLOCK_BYTES = 1 << 20


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, from running minima of aligned blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def grams(hashed: T.RangeHash, first: int, end: int) -> np.ndarray:
    """Hashes of the strings of ``GRAM`` bytes at each place of a text."""
    at = np.arange(first, end - GRAM + 1)
    return hashed(at, at + GRAM)


def window_anchors(gram: np.ndarray) -> np.ndarray:
    """The anchor hash of each window of a text."""
    return sliding_min(gram, WINDOW - GRAM + 1)


def anchor_counts(gram: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of a text and how often their string occurs in it."""
    anchors = np.unique(least)
    # Anchors are low values; few other places of the text are as low.
    low, counts = np.unique(gram[gram <= anchors[-1]], return_counts=True)
    return anchors, counts[np.searchsorted(low, anchors)]


def suffix_order(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The suffixes of ``data`` that start at ``wanted`` (sorted positions), in order of
    their first ``WINDOW`` bytes and a little more."""
    # A last byte above all others, which no text holds, ends every run.
    data = np.append(data, np.uint8(255))
    n = len(data)
    # A suffix is smaller than its successor if the next other byte is greater.
    change = np.flatnonzero(data[1:] != data[:-1])
    last = np.repeat(change, np.diff(change, prepend=-1))
    ascending = np.zeros(n, bool)
    ascending[:len(last)] = data[last + 1] > data[last]

    # Every other suffix is induced from its successor, so the chain of successors up to one
    # that is sorted directly comes along.
    up = np.flatnonzero(ascending)
    chain_end = up[np.searchsorted(up, wanted)]
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, wanted, 1)
    np.add.at(steps, chain_end + 1, -1)
    held = np.cumsum(steps[:-1]) > 0
    direct = np.flatnonzero(held & ascending)
    is_induced = held & ~ascending

    direct = _sort_directly(data, direct)
    by_byte = np.searchsorted(data[direct], np.arange(257))
    filled: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for byte in range(256):
        # Induced suffixes come first in a bucket, and those that repeat its byte last of
        # them; they join the list while it is scanned.
        mine = filled[byte]
        own = direct[by_byte[byte]:by_byte[byte + 1]]
        at = 0
        while at <= len(mine):
            part = mine[at] if at < len(mine) else own
            at += 1
            order.append(part)
            before = part[part > 0] - 1
            before = before[is_induced[before]]
            head = data[before]
            for c in np.unique(head):
                filled[c].append(before[head == c])
            if part is own:
                break
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    keep = np.zeros(n, bool)
    keep[wanted] = True
    return order[keep[order]]


def _key(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at ``at + depth`` as a number; bytes past the end are zero."""
    key = np.zeros(len(at), np.uint64)
    for i in range(8):
        where = at + depth + i
        key = (key << np.uint64(8)) | np.where(where < len(data), data[np.minimum(where, len(data) - 1)], 0).astype(np.uint64)
    return key


def _sort_directly(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at`` by the ``WINDOW`` bytes from there: by number for 16 bytes, then the ties."""
    keys = [_key(data, at, 8), _key(data, at, 0)]
    order = np.lexsort(keys)
    at = at[order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = np.all([k[order][1:] == k[order][:-1] for k in keys], axis=0) if len(at) else False
    raw = data.tobytes()
    for first, end in zip(*T.runs(same[1:] | same[:-1])):
        # A run of ties may hold several keys, whose order it already has.
        cut = np.flatnonzero(~same[first:end + 1][:end - first]) + first
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), int(end)]):
            part = at[a:b].tolist()
            part.sort(key=lambda p: raw[p + 16:p + WINDOW + 16])
            at[a:b] = part
    return at


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Bytes shared by each suffix of ``order`` and the one before it, up to ``most``; the
    first has none."""
    shared = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for depth in range(0, most, 8):
        if not len(open_):
            break
        a, b = _key(data, order[open_], depth), _key(data, order[open_ - 1], depth)
        equal = a == b
        unequal = open_[~equal]
        if len(unequal):
            gap = (a ^ b)[~equal]
            lead = 7 - np.floor(np.log2(gap.astype(np.float64))).astype(np.int64) // 8
            shared[unequal] = depth + np.clip(lead, 0, 7)
        open_ = open_[equal]
        shared[open_] = depth + 8
    return np.minimum(shared, most)


def repeated_windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the windows at ``starts`` (sorted) occur twice among them."""
    order = suffix_order(data, starts)
    long = common_prefixes(data, order) >= WINDOW
    both = long.copy()
    both[:-1] |= long[1:]
    flags = np.zeros(len(data), bool)
    flags[order[both]] = True
    return flags[starts]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, T.RangeHash, int, int]]:
    for first, end, data, offsets in T.chunks(batch.column("text")):
        hashed = T.byte_hash(data)
        for i in range(end - first):
            yield first + i, data, hashed, int(offsets[i]), int(offsets[i + 1])


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        texts = [np.zeros(0, np.int64)]
        names = batch.column("text_id").to_numpy()
        for row, _, hashed, first, end in _texts(batch):
            if end - first >= WINDOW:
                gram = grams(hashed, first, end)
                anchors, times = anchor_counts(gram, window_anchors(gram))
                hashes.append(anchors)
                counts.append(times)
                texts.append(np.full(len(anchors), names[row]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(texts)),
                pa.array(np.concatenate(counts).astype(np.int64)),
            ],
            names=["anchor", "text_id", "times"],
        )


_CONTEXTS = "array<struct<anchor:long,context_id:long,first:int,context:binary>>"


def _contexts(data, hashed, first: int, end: int, hits: list[int], sent: set) -> list[dict]:
    """The contexts of a text under the given anchors; ``sent`` has those of the batch whose
    bytes went out already."""
    least = window_anchors(grams(hashed, first, end))
    hit = np.isin(least, np.array(hits, np.int64).view(np.uint64))
    edge = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts, stops = np.append(0, edge), np.append(edge, len(least))
    starts, stops = starts[hit[starts]], stops[hit[starts]]
    names = hashed(first + starts, first + stops + WINDOW - 1).view(np.int64).tolist()
    anchors = least[starts].view(np.int64).tolist()
    found = []
    for anchor, name, a, b in zip(anchors, names, starts.tolist(), stops.tolist()):
        new = (anchor, name) not in sent
        sent.add((anchor, name))
        context = data[first + a:first + b + WINDOW - 1].tobytes() if new else None
        found.append({"anchor": anchor, "context_id": name, "first": a, "context": context})
    return found


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of texts with hits. Copied texts, and texts without contexts, get their
    result; a copied text sends its contexts from one row for the others to meet."""
    kind = pa.list_(pa.struct([
        ("anchor", pa.int64()), ("context_id", pa.int64()), ("first", pa.int32()),
        ("context", pa.binary()),
    ]))
    for batch in batches:
        hits = batch.column("hits").to_pylist()
        copied, stands = batch.column("copied").to_pylist(), batch.column("stands").to_pylist()
        n, gone, spans, shas, raws, contexts = [], [], [], [], [], []
        sent: set[tuple[int, int]] = set()
        for row, data, hashed, first, end in _texts(batch):
            long = end - first >= WINDOW
            found = None
            if hits[row] and long and (stands[row] or not copied[row]):
                found = _contexts(data, hashed, first, end, hits[row], sent)
            raw = data[first:end].tobytes()
            open_ = bool(found) and not copied[row]
            kept = b"" if copied[row] and long else raw
            n.append(end - first)
            gone.append(None if open_ else len(raw) - len(kept))
            spans.append(None if open_ else int(len(kept) < len(raw)))
            shas.append(None if open_ else hashlib.sha256(kept).hexdigest())
            raws.append(raw if open_ else kept)
            contexts.append(found)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("text_id"), pa.array(n, pa.int64()),
                pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()),
                pa.array(raws, pa.binary()), pa.array(contexts, kind),
            ],
            names=["doc_id", "text_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "raw", "contexts"],
        )


def _flush(anchors: list, names: list, counts: list, contexts: list) -> pa.RecordBatch:
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts])
    begin = np.cumsum(size) - size
    n_windows = size - WINDOW + 1
    starts = np.repeat(begin - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(n_windows.sum())
    flags = repeated_windows(data, starts)
    ranges, at = [], 0
    for n, count in zip(n_windows.tolist(), counts):
        mine = np.ones(n, bool) if count > 1 else flags[at:at + n]
        at += n
        first, end = T.runs(mine)
        ranges.append([{"first": a, "end": b + WINDOW - 1} for a, b in zip(first.tolist(), end.tolist())])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(anchors, pa.int64()), pa.array(names, pa.int64()), pa.array(ranges, kind)],
        names=["anchor", "context_id", "ranges"],
    )


def _sort_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole anchors; the rows come in order of their anchor."""
    held, size, last = ([], [], [], []), 0, None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("anchor", "context_id", "copies", "context"))
        for values in zip(*columns):
            if size >= BLOCK_BYTES and values[0] != last:
                yield _flush(*held)
                held, size = ([], [], [], []), 0
            last = values[0]
            size += len(values[3])
            for column, value in zip(held, values):
                column.append(value)
    if held[0]:
        yield _flush(*held)


def _remove_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, shas, texts = [], [], [], []
        for raw, ranges in zip(batch.column("raw").to_pylist(), batch.column("ranges").to_pylist()):
            data = np.frombuffer(raw, np.uint8)
            steps = np.zeros(len(data) + 1, np.int32)
            for r in ranges or ():
                steps[r["first"]] += 1
                steps[r["end"]] -= 1
            gone = np.cumsum(steps[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(len(T.runs(gone)[0]))
            kept = data[~gone].tobytes()
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode(errors="replace"))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
        )


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """Per document: its bytes, how many lie in a ``WINDOW``-byte string that also starts
    elsewhere, in how many runs, the hash of the others, and ``kept_text``, those as text,
    where a character that was cut through is replaced.

    A null text is empty; a null key stays null; repeated rows repeat each other; an empty
    table gives an empty result; columns other than key and text are ignored.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    # Texts are told by content: copies are counted, and one of them stands for all.
    named = docs.select(
        "doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("text_id")
    )
    anchors = named.select("text", "text_id").mapInArrow(
        _anchor_batches, "anchor long, text_id long, times long"
    )
    anchors = stage(anchors.distinct(), "anchors")
    often = anchors.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor")
    hits = anchors.join(stage(often, "repeated-anchors"), "anchor").groupBy("text_id").agg(
        F.collect_set("anchor").alias("hits")
    )
    copies = named.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")
    ).filter("n > 1").drop("n")
    facts = stage(hits.join(copies.withColumn("copied", F.lit(True)), "text_id", "full"), "text-facts")

    with_facts = named.join(facts, "text_id", "left").select(
        "doc_id", "text", "text_id", "hits", F.coalesce("copied", F.lit(False)).alias("copied"),
        F.col("doc_id").eqNullSafe(F.col("first_doc")).alias("stands"),
    )
    opened = stage(
        with_facts.mapInArrow(
            _context_batches,
            f"doc_id {key}, text_id long, n_bytes long, n_removed long, n_spans long, "
            f"kept_sha256 string, raw binary, contexts {_CONTEXTS}",
        ),
        "contexts",
    )
    contexts = opened.select(F.explode("contexts").alias("c")).select("c.*")
    distinct = contexts.repartition("anchor").groupBy("anchor", "context_id").agg(
        F.first("context", ignorenulls=True).alias("context"), F.count(F.lit(1)).alias("copies")
    )
    ranges = distinct.sortWithinPartitions("anchor").mapInArrow(
        _sort_batches, "anchor long, context_id long, ranges array<struct<first:int,end:int>>"
    )
    ranges = stage(ranges.filter(F.size("ranges") > 0), "repeated-ranges")
    open_texts = opened.filter("kept_sha256 IS NULL")
    placed = (
        open_texts.select("text_id", F.explode("contexts").alias("c"))
        .select("text_id", "c.anchor", "c.context_id", "c.first").distinct()
        .join(ranges, ["anchor", "context_id"])
        .withColumn("ranges", F.transform("ranges", lambda r: F.struct(
            (r["first"] + F.col("first")).alias("first"), (r["end"] + F.col("first")).alias("end")
        )))
        .groupBy("text_id").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    )
    cut = open_texts.select("doc_id", "text_id", "n_bytes", "raw").join(placed, "text_id", "left")
    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    settled = opened.filter("kept_sha256 IS NOT NULL")
    return settled.select(*result, F.col("raw").cast("string").alias("kept_text")).union(
        cut.mapInArrow(
            _remove_batches,
            f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string",
        )
    )


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))
