"""Secret scans over an incremental ledger of content-addressed blobs.

Each version of a text is a blob named by its SHA-256. The ledger lists which blobs were
scanned under which rule version; a run scans only the pairs it lacks, once for however
many paths share a blob, and joins the stored findings back to all paths. Hashing and
dedup move narrow rows only; the text of a blob is shuffled once, by the key of the one
row that stands for it, so a much-copied blob is no hot key.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import text as T
from demandlake.llm.tables import stage, table, text_or_empty
from demandlake.session import scratch_path

RULE_VERSION = "2024-1"
BASE_KINDS = ("assign", "access", "hex")
# kind, pattern, a literal that every match holds (or None), least length, group measured
# Patterns of the three base kinds.
RULES = (
    (
        "assign",
        re.compile(
            r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
            re.IGNORECASE | re.ASCII,
        ),
        None, 8, 2,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), "AKIA", 16, 0),
    ("hex", re.compile(r"[0-9a-f]{32,}"), None, 32, 0),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), "PRIVATE KEY", 1, 0),
    ("jwt", re.compile(r"eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}", re.ASCII), "eyJ", 1, 0),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), "gh", 1, 0),
)
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then by the order of the kinds."""
    found = []
    for order, (kind, pattern, literal, least, group) in enumerate(RULES):
        if literal is not None and literal not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs, spans = [], []
        for blob, text in zip(batch.column("blob"), batch.column("text")):
            blobs.append(blob.as_py())
            spans.append([
                {"kind": k, "start": s, "end": e} for k, s, e in scan_text(text.as_py())
            ])
        yield pa.RecordBatch.from_arrays(
            [pa.array(blobs, pa.string()), pa.array(spans, _SPANS)], names=["blob", "spans"]
        )


class BlobLedger:
    """Scanned (blob, rule version) pairs and their findings, as two Parquet tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.scans = f"{root}/scans"
        self.findings = f"{root}/findings"

    def _read(self, path: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        if where.getFileSystem(hadoop).exists(where):
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.createDataFrame([], schema)

    def scanned(self, rule_version: str) -> DataFrame:
        rows = self._read(self.scans, "blob string, rule_version string")
        return rows.filter(F.col("rule_version") == rule_version).select("blob").distinct()

    def found(self, rule_version: str) -> DataFrame:
        rows = self._read(self.findings, f"blob string, spans {SPAN_TYPE}, rule_version string")
        return (
            rows.filter(F.col("rule_version") == rule_version)
            .groupBy("blob").agg(F.first("spans").alias("spans"))
        )

    def update(self, versions: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
        """Scan the blobs of ``versions(key, blob, text)`` that the ledger lacks.

        Findings are written before the scan is recorded: a run that dies between the
        two repeats the scan, and ``found`` reads one row per blob all the same.
        Returns the newly scanned blobs.
        """
        unseen = (
            versions.select("key", "blob").groupBy("blob").agg(F.min("key").alias("key"))
            .join(self.scanned(rule_version), "blob", "left_anti")
        )
        unseen = stage(unseen, "unseen-blobs")
        new = versions.join(unseen, ["key", "blob"]).select("blob", "text")
        scanned = new.mapInArrow(_scan_batches, f"blob string, spans {SPAN_TYPE}")
        stamp = F.lit(rule_version).alias("rule_version")
        (
            scanned.filter(F.size("spans") > 0).select("blob", "spans", stamp)
            .write.mode("append").parquet(self.findings)
        )
        unseen.select("blob", stamp).write.mode("append").parquet(self.scans)
        return unseen.select("blob")


def blobs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` as text, blob name and text; a null text is the empty blob."""
    return docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
        F.sha2(text_or_empty().cast("binary"), 256).alias("blob"),
        text_or_empty().alias("text"),
    )


def find_secrets(
    docs: DataFrame, ledger_root: str | None = None, rule_version: str = RULE_VERSION,
    key: str = "doc_id",
) -> DataFrame:
    """One row per input row: key, blob and its spans (an empty array for none).

    Repeated rows give repeated results, a null key stays null, an empty table gives an
    empty result, and columns other than key and text are ignored. A ledger folder that
    is given again is only extended.
    """
    spark = docs.sparkSession
    ledger = BlobLedger(spark, ledger_root or scratch_path(spark, "blob-ledger"))
    ledger.update(blobs(docs, key), rule_version)
    paths = docs.select(
        F.col(key), F.sha2(text_or_empty().cast("binary"), 256).alias("blob")
    )
    return paths.join(ledger.found(rule_version), "blob", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(SPAN_TYPE))
    )


def joined_spans(spans):
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op9_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
    )


def _redacted(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at:s["start"]], "[secret]"]
        at = s["end"]
    return "".join([*out, text[at:]])


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = batch.drop_columns(["__spans"])
        place = rest.schema.get_field_index("text")
        for first, end, _, _ in T.chunks(batch.column("text")):
            part = rest.slice(first, end - first)
            found = batch.column("__spans").slice(first, end - first).to_pylist()
            if any(found):
                texts = [
                    _redacted(t, spans) if spans else t
                    for t, spans in zip(part.column("text").to_pylist(), found)
                ]
                part = part.set_column(place, "text", pa.array(texts, pa.string()))
            yield part


def redact_secrets(docs: DataFrame, ledger_root: str | None = None) -> DataFrame:
    """``docs`` with each found span replaced by ``[secret]``; all else is unchanged.

    ``n_chars``, where there is one, follows the new text. A null text stays null.
    """
    spark = docs.sparkSession
    ledger = BlobLedger(spark, ledger_root or scratch_path(spark, "blob-ledger"))
    ledger.update(blobs(docs), RULE_VERSION)
    hits = stage(ledger.found(RULE_VERSION).withColumnRenamed("spans", "__spans"), "secret-blobs")
    named = docs.withColumn("__blob", F.sha2(text_or_empty().cast("binary"), 256))
    joined = named.join(hits, named["__blob"] == hits["blob"], "left").select(
        *(named[c] for c in docs.columns), hits["__spans"]
    )
    clean = joined.mapInArrow(_redact_batches, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return clean
