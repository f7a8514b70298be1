"""Chat formatting of typed content parts, with a loss mask, attachments and token counts.

A visitor flattens the parts of a turn: text is escaped, an image, audio or document becomes a
numbered placeholder, its reference and the tokens it will expand to are recorded. Every
control string begins with a sign that escaped text never holds bare, so a reader gets turns
and parts back exactly. Turns are dealt by ranges of conversation and turn, so that a
conversation of any length is formatted by many tasks, in chunks of bounded size.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm.tables import stage, table
from demandlake.llm.tokens import TOKENIZER_FILE, encode_texts, tokenizer_path

# The template: "### role: " opens a turn, "</turn>\n" ends it, "<|kind:number|>" is a part.
OPENING, NAMED, CLOSING = "### ", ": ", "</turn>\n"
LEARNT_ROLE = "assistant"
KINDS = ("image", "audio", "document")
# Characters of a chunk of whole turns; a longer turn is a chunk of its own.
CHUNK_CHARS = 1 << 20
# A side of an image patch in pixels, tokens of a second of audio and of a document's page.
PATCH, SECOND_TOKENS, PAGE_TOKENS = 28, 25, 256

PARTS = (
    "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
)
_ATTACHMENT = pa.struct([
    ("turn", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64()),
])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
CHUNKS = (
    "conv_id {key}, part long, n_turns long, formatted string, loss array<struct<start:long,end:long>>, "
    "attachments array<struct<turn:long,kind:string,ref:string,at:long,tokens:long>>, n_tokens long"
)
_PLAIN = r"[^\\#<]*"
_BODY = rf"{_PLAIN}(?:(?:\\.|<\|[a-z]+:\d+\|>){_PLAIN})*"
_TURN = re.compile(rf"### ([^\\#<:]*(?:\\.[^\\#<:]*)*): ({_BODY})</turn>\n", re.DOTALL)
_PLACEHOLDER = re.compile(r"\\.|<\|([a-z]+):(\d+)\|>", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace("#", "\\#")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _positive(value, unit: float) -> int:
    """How many units a measure takes, one at least; unknown measures count as one."""
    known = value is not None and math.isfinite(value) and value > 0
    return max(1, math.ceil(value * unit)) if known else 1


@dataclass
class PartVisitor:
    """Flattens the parts of one turn, in their order."""

    body: str = ""
    texts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)  # of text, within the body
    attachments: list[tuple[str, str | None, int, int]] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        coded = escape(text)
        if coded:
            self.spans.append((len(self.body), len(self.body) + len(coded)))
            self.texts.append(text)
            self.body += coded

    def visit_image(self, part: dict) -> None:
        self._hold("image", part, _positive(part.get("width"), 1 / PATCH) * _positive(part.get("height"), 1 / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._hold("audio", part, _positive(part.get("seconds"), SECOND_TOKENS))

    def visit_document(self, part: dict) -> None:
        self._hold("document", part, _positive(part.get("pages"), PAGE_TOKENS))

    def visit_other(self, part: dict) -> None:
        self._hold("other", part, 1)

    def _hold(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((kind, part.get("ref"), len(self.body), tokens))
        self.body += f"<|{kind}:{len(self.attachments)}|>"


def read_turns(formatted: str) -> list[tuple[str, int, int]]:
    """``(role, start, end)`` of each turn, the range that of its body."""
    turns, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            break
        turns.append((unescape(found[1]), found.start(2), found.end(2)))
        at = found.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def read_parts(body: str) -> list[tuple[str, str | int]]:
    """``(kind, text or number)`` of a body's parts; neighbouring texts are one."""
    parts, at = [], 0
    for found in _PLACEHOLDER.finditer(body) if "<" in body else ():
        if found[1]:
            if at < found.start():
                parts.append(("text", unescape(body[at:found.start()])))
            parts.append((found[1], int(found[2])))
            at = found.end()
    if at < len(body):
        parts.append(("text", unescape(body[at:])))
    return parts


class _Chunk:
    def __init__(self, key):
        self.key, self.size, self.turns, self.tokens = key, 0, 0, 0
        self.text: list[str] = []
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def add(self, role: str, visitor: PartVisitor, tokens: int) -> None:
        head = OPENING + escape(role).replace(":", "\\:") + NAMED
        at = self.size + len(head)
        if role == LEARNT_ROLE:
            self.loss += [{"start": at + a, "end": at + b} for a, b in visitor.spans]
        for kind, ref, place, expanded in visitor.attachments:
            self.attachments.append(
                {"turn": self.turns, "kind": kind, "ref": ref, "at": at + place, "tokens": expanded}
            )
            tokens += expanded
        self.text += [head, visitor.body, CLOSING]
        self.size = at + len(visitor.body) + len(CLOSING)
        self.turns += 1
        self.tokens += tokens


def _chunk_rows(chunks: list[_Chunk], part: int, key: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([c.key for c in chunks], key),
            pa.array(range(part, part + len(chunks)), pa.int64()),
            pa.array([c.turns for c in chunks], pa.int64()),
            pa.array(["".join(c.text) for c in chunks], pa.string()),
            pa.array([c.loss for c in chunks], pa.list_(_SPAN)),
            pa.array([c.attachments for c in chunks], pa.list_(_ATTACHMENT)),
            pa.array([c.tokens for c in chunks], pa.int64()),
        ],
        names=[c.split()[0] for c in CHUNKS.split(", ")],
    )


def _format_batches(path: str, chunk_chars: int):
    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Parts are numbered in the order of the rows: ranges first, then places in them.
        part, done, held, kind = TaskContext.get().partitionId() << 40, [], 0, None
        chunk = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            content = batch.column("content").to_pylist()
            visitors = []
            for parts in content:
                visitor = PartVisitor()
                for one in parts or ():
                    if one is not None:
                        visitor.visit(one)
                visitors.append(visitor)
            joined = pa.array([" ".join(v.texts) for v in visitors], pa.large_string())
            # The end token of each text is not the formatter's.
            tokens = [n - 1 for _, _, bounds in encode_texts(joined, path) for n in np.diff(bounds).tolist()]
            keys, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
            for key, role, visitor, n in zip(keys, roles, visitors, tokens):
                if chunk is None or key != chunk.key or chunk.size >= chunk_chars:
                    if chunk is not None:
                        done.append(chunk)
                        held += chunk.size
                    chunk = _Chunk(key)
                chunk.add(role or "", visitor, n)
                if held >= chunk_chars:
                    yield _chunk_rows(done, part, kind)
                    part, done, held = part + len(done), [], 0
        if chunk is not None:
            yield _chunk_rows([*done, chunk], part, kind)

    return formatted


def format_conversations(
    turns: DataFrame, tokenizer: str = TOKENIZER_FILE, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """Chunks of whole turns, ordered by conversation and ``part``: the formatted text, the
    character ranges that count for the loss, the attachments by turn of the chunk, and the
    tokens, placeholders expanded.

    ``turns`` holds ``conv_id``, ``turn``, ``role``, and ``parts`` (see ``PARTS``) or, where it
    lacks them, ``text``. Null texts, parts and roles are empty; a null turn comes before the others;
    turns of one number follow by role, then by a hash of their content, and repeated rows
    are turns each; rows with a null key form one conversation; an empty table gives an empty
    result; a part of an unknown kind is held as one token; other columns are ignored.
    """
    key = turns.schema["conv_id"].dataType.simpleString()
    if "parts" in turns.columns:
        content = F.col("parts").cast(PARTS)
    else:
        content = F.array(F.struct(F.lit("text").alias("kind"), "text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"))
    order = ["conv_id", "turn", "role", "content_hash"]
    rows = rows.withColumn("content_hash", F.xxhash64("content")).repartitionByRange(*order)
    rows = rows.sortWithinPartitions(*order).select("conv_id", "role", "content")
    return rows.mapInArrow(_format_batches(tokenizer_path(tokenizer), chunk_chars), CHUNKS.format(key=key))


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts_kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("ref", pa.string())]))
    for batch in batches:
        keys, parts = batch.column("conv_id"), batch.column("part").to_pylist()
        owner, place, roles, contents = [], [], [], []
        texts, held = batch.column("formatted").to_pylist(), batch.column("attachments").to_pylist()
        for row, (text, attachments) in enumerate(zip(texts, held)):
            refs: dict[int, list] = {}
            for a in attachments:
                refs.setdefault(a["turn"], []).append(a["ref"])
            for n, (role, start, end) in enumerate(read_turns(text)):
                owner.append(row)
                place.append(n)
                roles.append(role)
                contents.append([
                    {"kind": k, "text": v} if k == "text" else {"kind": k, "ref": refs[n][v - 1]}
                    for k, v in read_parts(text[start:end])
                ])
        yield pa.RecordBatch.from_arrays(
            [
                keys.take(pa.array(owner, pa.int64())), pa.array([parts[r] for r in owner], pa.int64()),
                pa.array(place, pa.int64()), pa.array(roles, pa.string()), pa.array(contents, parts_kind),
            ],
            names=["conv_id", "part", "place", "role", "parts"],
        )


def read_conversations(chunks: DataFrame) -> DataFrame:
    """The turns of formatted chunks, ordered by conversation, ``part`` and ``place``, with
    their parts as they were (neighbouring and empty texts excepted)."""
    key = chunks.schema["conv_id"].dataType.simpleString()
    return chunks.select("conv_id", "part", "formatted", "attachments").mapInArrow(
        _read_batches,
        f"conv_id {key}, part long, place long, role string, "
        "parts array<struct<kind:string,text:string,ref:string>>",
    )


_DIGEST = (
    "conv_id {key}, part long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_tokens long, turns_bytes binary, loss_bytes binary"
)
_COUNTS = ("n_turns", "loss_chars", "formatted_chars", "n_tokens")


def _read_chunk(row: dict) -> dict:
    """What a chunk adds to its conversation's result, read from its formatted text."""
    text = row["formatted"]
    turns = []
    for role, start, end in read_turns(text):
        words = "".join([v for k, v in read_parts(text[start:end]) if k == "text"])
        turns.append(f"{role}\n{words}\n")
    loss = "".join([unescape(text[s["start"]:s["end"]]) for s in row["loss"]])
    return {
        "conv_id": row["conv_id"], "part": row["part"], "n_turns": len(turns), "loss_chars": len(loss),
        "formatted_chars": len(text), "n_tokens": row["n_tokens"],
        "turns_bytes": "".join(turns).encode(), "loss_bytes": loss.encode(),
    }


class _Digest:
    """The result of one conversation, a piece after the other."""

    def __init__(self, piece: dict):
        self.key, self.counts = piece["conv_id"], dict.fromkeys(_COUNTS, 0)
        self._turns, self._loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: dict) -> None:
        for name in _COUNTS:
            self.counts[name] += piece[name]
        self._turns.update(piece["turns_bytes"])
        self._loss.update(piece["loss_bytes"])

    def row(self) -> dict:
        return {
            "conv_id": self.key, **self.counts,
            "turns_sha256": self._turns.hexdigest(), "loss_sha256": self._loss.hexdigest(),
        }


def _schema(key: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds.get(k, key)) for n, k in (c.split() for c in _DIGEST.split(", "))])


_ROWS = 1000


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations that lie within the range; of its first and last one, which
    may go on in the next range, the pieces."""
    schema, out, held = None, [], 0
    first = digest = None
    # Pieces of the conversation being read, until it is known to be a whole one.
    pieces: list[dict] = []

    for batch in batches:
        schema = schema or _schema(batch.schema.field("conv_id").type)
        for row in batch.to_pylist():
            piece = _read_chunk(row)
            if digest is None:
                first = digest = _Digest(piece)
            elif piece["conv_id"] != digest.key:
                out += pieces if digest is first else [digest.row()]
                digest, pieces = _Digest(piece), []
            digest.add(piece)
            pieces.append(piece)
            held += len(piece["turns_bytes"])
            if digest is first or held >= 8 * CHUNK_CHARS:
                # A conversation so long is passed on in pieces; they are counted once.
                if digest is not first:
                    first = digest
                out, pieces = out + pieces, []
            if len(out) >= _ROWS or held >= 8 * CHUNK_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
    if pieces or out:
        yield pa.RecordBatch.from_pylist(out + pieces, schema)


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its pieces, which come in order."""
    schema, digest, out = None, None, []
    for batch in batches:
        schema = schema or _schema(batch.schema.field("conv_id").type)
        for piece in batch.to_pylist():
            if digest is None or piece["conv_id"] != digest.key:
                if digest is not None:
                    out.append(digest.row())
                digest = _Digest(piece)
            digest.add(piece)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if digest is not None:
        yield pa.RecordBatch.from_pylist([digest.row()], schema)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, from its formatted text: turns, hash of roles and texts, characters
    and hash of the text under the loss mask, characters of the format, and tokens.

    Edge cases are those of ``format_conversations``; a part other than text adds nothing to
    a turn's text here. A hash runs along its conversation: the pieces of one that goes
    beyond a range of turns are formatted and read by many tasks, and streamed through one
    that holds a piece at a time.
    """
    key = turns.schema["conv_id"].dataType.simpleString()
    kind = _DIGEST.format(key=key)
    # Rows stay where they were formatted, in their order.
    read = stage(format_conversations(turns).mapInArrow(_piece_batches, kind), "conversations")
    result = [c.split()[0] for c in _DIGEST.split(", ") if c.split()[0] not in ("part", "turns_bytes", "loss_bytes")]
    pieces = read.filter("part IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    joined = pieces.mapInArrow(_join_batches, kind).select(*result)
    return read.filter("part IS NULL").select(*result).union(joined)


PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op12_part_visitor_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(turns.union(probe))
