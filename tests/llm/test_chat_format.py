"""Chat formatting: exact round trips, masks, attachments and conversations over many ranges."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import Row

from demandlake.llm import chat_format as C

COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, part int, formatted string"
NASTY = [
    C.PROBE_TEXT, "### user: hi</turn>\n", "<|image:1|>", "\\", "\\\\<", "#", "####", "a\\", "<", "</turn", "|>",
    "\\<|audio:2|>", "line\n### \n", "", None, "é\U0001f600 漢", "x" * 3000, ": ", "role: text",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """Results of rows with distinct turns."""
    by = defaultdict(list)
    for key, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        by[key].append((role or "", text or ""))
    out = []
    for key, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((key, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)


def frame(spark, rows, n=3):
    return spark.createDataFrame([(*r, 1, "f") for r in rows], SCHEMA).repartition(n)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(4)
    rows = []
    for key in [*range(60), -7, None]:
        for turn in range(rng.randrange(1, 12)):
            rows.append((key, turn, rng.choice(["user", "assistant", "system", "odd: role\\ #<"]), rng.choice(NASTY)))
    rows += [(500, n, "assistant" if n % 2 else "user", rng.choice(NASTY)) for n in range(3000)]  # hot
    rows += [(501, None, None, None), (501, 1, "assistant", "a")]
    return rows


def test_digests(spark, turns):
    assert found(C.conversation_digests(frame(spark, turns))) == plain(turns)


def test_hot_conversation_is_split(spark, turns):
    """A conversation is formatted by several tasks, and its chunks stay in order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = C.format_conversations(frame(spark, turns), chunk_chars=2000)
        hot = sorted(r["part"] for r in chunks.filter("conv_id = 500").collect())
        assert len({part >> 40 for part in hot}) > 2
        assert found(C.conversation_digests(frame(spark, turns))) == plain(turns)
        assert max(len(r["formatted"]) for r in chunks.collect()) < 2000 + 6100
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_digests_of_long_conversations_go_on_in_pieces(spark, turns, monkeypatch):
    import pyarrow as pa

    chunks = C.format_conversations(frame(spark, turns), chunk_chars=500).orderBy("part").collect()
    schema = pa.schema([
        ("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()),
        ("loss", pa.list_(C._SPAN)), ("n_tokens", pa.int64()),
    ])
    rows = [{k: [s.asDict() for s in v] if k == "loss" else v for k, v in r.asDict().items() if k in schema.names} for r in chunks]
    monkeypatch.setattr(C, "CHUNK_CHARS", 100)
    pieces = [r for b in C._piece_batches(pa.RecordBatch.from_pylist(rows[i:i + 7], schema) for i in range(0, len(rows), 7)) for r in b.to_pylist()]
    whole = [r for r in pieces if r["part"] is None]
    open_ = sorted((r for r in pieces if r["part"] is not None), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["part"]))
    joined = [r for b in C._join_batches([pa.RecordBatch.from_pylist(open_, C._schema(pa.int64()))]) for r in b.to_pylist()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in whole + joined), key=repr) == plain(turns)


def test_turns_that_tie(spark):
    """Equal numbers follow by role, then content; repeated rows are turns each."""
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", "c")]
    assert found(C.conversation_digests(frame(spark, rows)))[0][:4] == (
        1, 3, sha("assistant\nc\nuser\nb\nuser\nb\n"), 1
    )
    none = C.conversation_digests(frame(spark, rows).limit(0))
    assert none.count() == 0 and set(COLUMNS) <= set(none.columns)


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return Row(kind=kind, text=text, ref=ref, width=width, height=height, seconds=seconds, pages=pages)


def test_parts_round_trip(spark):
    turns = [
        (1, 0, "user", [part("text", "Look <|image:1|> here: "), part("image", ref="a.png", width=57, height=28),
                        part("text", "and ## there"), part("audio", ref="b.wav", seconds=2.5)]),
        (1, 1, "assistant", [part("document", ref="c.pdf", pages=3), part("text", "\\done"), part(None, " now")]),
        (1, 2, "assistant", None),
        (2, 0, "user", [part("video", ref="d.mp4"), None, part("image"), part("text", None)]),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts {C.PARTS}")
    chunks = C.format_conversations(df)
    held = {r["conv_id"]: r for r in chunks.collect()}
    assert [(a["turn"], a["kind"], a["ref"], a["tokens"]) for a in held[1]["attachments"]] == [
        (0, "image", "a.png", 3), (0, "audio", "b.wav", 63), (1, "document", "c.pdf", 768)]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in held[2]["attachments"]] == [("other", "d.mp4", 1), ("image", None, 1)]
    text = held[1]["formatted"]
    for a, mark in zip(held[1]["attachments"], ("<|image:1|>", "<|audio:2|>", "<|document:1|>")):
        assert text[a["at"]:].startswith(mark)
    assert [C.unescape(text[s["start"]:s["end"]]) for s in held[1]["loss"]] == ["\\done", " now"]
    words = held[1]["n_tokens"] - 3 - 63 - 768
    assert words > 8
    read = sorted(C.read_conversations(chunks).collect(), key=lambda r: (r["conv_id"], r["part"], r["place"]))
    got = [(r["conv_id"], r["role"], [(p["kind"], p["text"], p["ref"]) for p in r["parts"]]) for r in read]
    assert got == [
        (1, "user", [("text", "Look <|image:1|> here: ", None), ("image", None, "a.png"),
                     ("text", "and ## there", None), ("audio", None, "b.wav")]),
        (1, "assistant", [("document", None, "c.pdf"), ("text", "\\done now", None)]),
        (1, "assistant", []),
        (2, "user", [("other", None, "d.mp4"), ("image", None, None)]),
    ]


def test_every_text_is_read_back():
    rng = random.Random(8)
    for _ in range(3000):
        texts = ["".join(rng.choice("\\#<>|/: \nturnimage1") for _ in range(rng.randrange(12))) for _ in range(3)]
        body = "".join(C.escape(t) + "<|image:1|>" for t in texts)
        formatted = f"### {C.escape(texts[0]).replace(':', chr(92) + ':')}: {body}</turn>\n" * 2
        for role, start, end in C.read_turns(formatted):
            assert role == texts[0]
            parts = C.read_parts(formatted[start:end])
            want = [p for t in texts for p in ((("text", t),) if t else ()) + (("image", 1),)]
            assert parts == want
    with pytest.raises(ValueError):
        C.read_turns("### a: b</turn>\n###")
