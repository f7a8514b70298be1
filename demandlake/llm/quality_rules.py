"""Quality rules with the frequency of lines across the documents of a host.

Lines are hashed by their lower-cased words. A line is boilerplate on a host when more than
``LINE_LIMIT`` distinct documents of the host hold it, and more than ``LINE_PERCENT`` of all
its distinct documents: copies of one text count once, and the verdict on a line does not
change with the size of its host. Boilerplate lines are removed, and a document that they
made up almost wholly, or that has too few words left, is rejected as depleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import text as T
from demandlake.llm.tables import stage, table, text_or_empty

LINE_LIMIT, LINE_PERCENT = 20, 5
# A document is depleted when less than this share of its words is left, or when lines were
# taken and fewer words are left than a document must have.
LEAST_LEFT_PERCENT = 20
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

# Bytes of texts measured at a time, whose arrays stay in the processor's cache.
MEASURED_BYTES = 1 << 18

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _line_words(data, offsets, words: T.Spans) -> tuple[T.Spans, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that hold a word, their first and end words, and the hash of their words."""
    lines = T.lines(data, offsets)
    first = np.searchsorted(words.starts, lines.starts)
    end = np.searchsorted(words.starts, lines.ends)
    held = end > first
    lines = T.Spans(
        lines.starts[held], lines.ends[held], lines.text[held], None, lines.hashes[held]
    )
    return lines, first[held], end[held], T.RangeHash(words.hashes)(first[held], end[held])


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text of a run, and its distinct lines as flat arrays."""
    n_texts = len(offsets) - 1
    words = T.words(data, offsets)
    lower = T.words(data, offsets, lower=True)
    out = {"n_words": np.diff(words.first)}
    letters = ~T.SPACE[data] & ((data & 0xC0) != 0x80)
    out["word_chars"] = T.per_text(letters, offsets)
    out["n_symbols"] = T.per_text(_SYMBOL[data], offsets)

    at, hashes = words.windows(3)
    twice = T.repeated(T.mix(hashes + words.text[at].astype(np.uint64)))
    flags = T.covered(len(words.starts), at[twice], 3)
    out["n_repeat_words"] = T.per_text(flags, words.first)

    lines, first, end, hashes = _line_words(data, offsets, lower)
    order = np.lexsort((lines.hashes, lines.text))
    later = (lines.hashes[order][1:] == lines.hashes[order][:-1]) & (
        lines.text[order][1:] == lines.text[order][:-1]
    )
    out["n_dup_lines"] = np.bincount(lines.text[order][1:][later], minlength=n_texts)

    order = np.lexsort((hashes, lines.text))
    text, hashes, size = lines.text[order], hashes[order], (end - first)[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    size = np.add.reduceat(size, np.flatnonzero(new)) if len(size) else size
    text, hashes = text[new], hashes[new]
    out["line_first"] = np.searchsorted(text, np.arange(n_texts + 1))
    out["line"], out["line_words"] = hashes, size
    return out


_MEASURED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lines array<struct<line:long,words:int>>"
)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in T.chunks(batch.column("text"), MEASURED_BYTES):
            m = measure(data, offsets)
            lines = pa.StructArray.from_arrays(
                [
                    pa.array(m["line"].view(np.int64)),
                    pa.array(m["line_words"].astype(np.int32)),
                ],
                names=["line", "words"],
            )
            columns = [pa.array(m[c].astype(np.int64)) for c in COUNTS]
            columns.append(pa.ListArray.from_arrays(pa.array(m["line_first"].astype(np.int32)), lines))
            keys = ["doc_id", "host", "text_hash"]
            part = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keys), *columns], names=[*keys, *COUNTS, "lines"]
            )


def frequent_lines(
    measured: DataFrame, line_limit: int = LINE_LIMIT, line_percent: float = LINE_PERCENT
) -> DataFrame:
    """``(host, line)`` of the lines that too many distinct texts of a host hold.

    One row stands for all that have its text; the others are told by joining the texts that
    occur more than once, so a text with very many copies counts like any other.
    """
    copied = measured.groupBy("host", "text_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row")
    ).filter("n > 1").select("host", "text_hash", "first_row")
    copied = stage(copied, "copied-texts")
    distinct = measured.join(copied, ["host", "text_hash"], "left").filter(
        "first_row IS NULL OR first_row = row"
    )
    totals = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    held = distinct.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(
        F.count(F.lit(1)).alias("held")
    )
    return held.filter(F.col("held") > line_limit).join(totals, "host").filter(
        100 * F.col("held") > line_percent * F.col("texts")
    ).select("host", "line")


def judge(
    docs: DataFrame, host: str = "source", line_limit: int = LINE_LIMIT, line_percent: float = LINE_PERCENT
) -> DataFrame:
    """One row per document: its counts, the hashes of its boilerplate lines, the words left
    without them, ``base_failed``, ``depleted`` and ``kept``.

    A null text has no words and fails; a null host is a host of its own; repeated rows are
    judged each, and count as one document; an empty table gives an empty result. Columns
    other than key, host and text are ignored.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.select(
        "doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.xxhash64("text").alias("text_hash"), "text",
    ).mapInArrow(_measure_batches, f"doc_id {key}, host string, text_hash long, {_MEASURED}")
    measured = stage(measured.withColumn("row", F.monotonically_increasing_id()), "measured")

    lines = measured.select("row", "host", F.explode("lines").alias("at")).select(
        "row", "host", "at.line", "at.words"
    )
    frequent = stage(frequent_lines(measured, line_limit, line_percent), "frequent-lines")
    lost = (
        lines.join(frequent, ["host", "line"], "left_semi").groupBy("row")
        .agg(F.sum("words").alias("lost"), F.collect_list("line").alias("cut_lines"))
    )
    base_failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    return (
        measured.drop("lines").join(lost, "row", "left").drop("row")
        .withColumn("n_left", F.col("n_words") - F.coalesce("lost", F.lit(0)))
        .withColumn("base_failed", base_failed)
        .withColumn(
            "depleted",
            (100 * F.col("n_left") < LEAST_LEFT_PERCENT * F.col("n_words"))
            | ((F.col("n_left") < LEAST_WORDS) & (F.col("n_left") < F.col("n_words"))),
        )
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .withColumn("cut_lines", F.coalesce("cut_lines", F.array().cast("array<long>")))
    )


def op8_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", *COUNTS, "base_failed", "kept", "n_left",
        F.size("cut_lines").cast("long").alias("n_cut_lines"),
    )


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = batch.drop_columns(["__cut_lines"])
        place = rest.schema.get_field_index("text")
        for first, end, data, offsets in T.chunks(batch.column("text")):
            part = rest.slice(first, end - first)
            cuts = batch.column("__cut_lines").slice(first, end - first).to_pylist()
            if any(cuts):
                texts = part.column("text").to_pylist()
                for i in filter(cuts.__getitem__, range(len(cuts))):
                    texts[i] = _without_lines(data[offsets[i]:offsets[i + 1]], cuts[i])
                part = part.set_column(place, "text", pa.array(texts, pa.string()))
            yield part


def _without_lines(data: np.ndarray, cut: list[int]) -> str:
    offsets = np.array([0, len(data)])
    lines, _, _, hashes = _line_words(data, offsets, T.words(data, offsets, lower=True))
    gone = np.isin(hashes.view(np.int64), np.array(cut, np.int64))
    left = np.ones(len(data), bool)
    for start, end in zip(lines.starts[gone], lines.ends[gone]):
        left[start:end + 1] = False
    return data[left].tobytes().decode()


def clean(
    docs: DataFrame, host: str = "source", line_limit: int = LINE_LIMIT, line_percent: float = LINE_PERCENT
) -> DataFrame:
    """The kept documents without their boilerplate lines; ``n_chars`` follows the text."""
    verdicts = (
        judge(docs, host, line_limit, line_percent).filter("kept")
        .groupBy("doc_id", "host", "text_hash").agg(F.first("cut_lines").alias("cut_lines"))
    )
    verdicts = stage(verdicts, "kept-documents")
    named = docs.withColumns({
        "__host": F.coalesce(F.col(host).cast("string"), F.lit("")),
        "__hash": F.xxhash64("text"),
    })
    joined = named.join(
        verdicts,
        named["doc_id"].eqNullSafe(verdicts["doc_id"])
        & (named["__host"] == verdicts["host"]) & (named["__hash"] == verdicts["text_hash"]),
    )
    cut = joined.select(*(named[c] for c in docs.columns), verdicts["cut_lines"].alias("__cut_lines")).mapInArrow(
        _cut_batches, docs.schema
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.length("text").cast(kind))
    return cut
