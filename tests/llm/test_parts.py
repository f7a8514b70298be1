"""The numpy parts of the operators on random input."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from demandlake.llm import near_dedup, quality_rules, secrets, suffix_dedup, text, tokens


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=13, max_size=120).map(lambda b: bytes(x % 3 + 97 for x in b)), st.randoms())
def test_suffix_order(raw, rng):
    old, suffix_dedup.WINDOW = suffix_dedup.WINDOW, 12
    try:
        raw += raw[rng.randrange(len(raw)):]
        data = np.frombuffer(raw, np.uint8)
        n = len(raw) - 11
        starts = np.array(sorted(rng.sample(range(n), rng.randint(1, n))))
        order = suffix_dedup.suffix_order(data, starts)
        assert sorted(order.tolist()) == starts.tolist()
        heads = [raw[i:i + 12] for i in order]
        assert heads == sorted(heads)
        counts = collections.Counter(raw[i:i + 12] for i in starts)
        expected = [counts[raw[i:i + 12]] > 1 for i in starts]
        assert suffix_dedup.repeated_windows(data, starts).tolist() == expected
    finally:
        suffix_dedup.WINDOW = old


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=5, max_size=60), st.integers(1, 5))
def test_sliding_min(values, width):
    values = np.array(values, np.uint64)
    expected = [values[i:i + width].min() for i in range(len(values) - width + 1)]
    assert suffix_dedup.sliding_min(values, width).tolist() == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words(texts):
    column = pa.array(texts, pa.string())
    for first, end, data, offsets in text.chunks(column):
        words = text.words(data, offsets)
        for i in range(end - first):
            mine = range(words.first[i], words.first[i + 1])
            found = [data[words.starts[k]:words.ends[k]].tobytes().decode() for k in mine]
            assert found == brute.WORD.findall(texts[first + i] or "")
    by_word = collections.defaultdict(set)
    for _, _, data, offsets in text.chunks(column):
        words = text.words(data, offsets)
        for k in range(len(words.starts)):
            by_word[data[words.starts[k]:words.ends[k]].tobytes()].add(int(words.hashes[k]))
    assert all(len(h) == 1 for h in by_word.values())


@pytest.fixture(scope="module")
def reader():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


LETTERS = st.text(st.one_of(
    st.characters(max_codepoint=0x2FF), st.sampled_from("aAeEéñÜßŉǅ .,;:!?'\"<|>09́ẞΣ"), st.characters(),
), max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(LETTERS, min_size=1, max_size=5))
def test_ids_are_the_tokenizers(reader, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["It's <|endoftext|> <|EndOfText|> don't."]
    for batch in (texts, texts[:-1]):
        for first, ids, bounds in tokens.encode_texts(pa.array(batch, pa.string()), tokens.tokenizer_path()):
            for i in range(len(bounds) - 1):
                expected = reader.encode(batch[first + i], add_special_tokens=False).ids + [1]
                assert ids[bounds[i]:bounds[i + 1]].tolist() == expected


@pytest.mark.parametrize("shared", [0.3, 0.75, 0.95])
def test_sketches_estimate_similarity(shared):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    n = 2000
    both = int(2 * n * shared / (1 + shared))
    a, b = values[:n], np.concatenate([values[:both], values[n:2 * n - both]])
    sketches = [near_dedup.registers(np.unique(s))[None, :] for s in (a, b)]
    found = near_dedup.estimate(*sketches, np.array([n]), np.array([n]))[0]
    assert abs(found - shared) < 0.12
    merged = near_dedup.registers(np.unique(np.concatenate([a, b])))
    assert (merged == np.maximum(*sketches)[0]).all()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (9, 8), (8, 7), (7, 6), (6, 9), (10, 1)], "a long, b long")
    found = sorted(map(tuple, near_dedup.components(edges).distinct().collect()))
    assert found == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 6), (9, 6), (10, 1)]


def _pages(n=3000):
    """About 5 MB of texts in one batch, of which every tenth has something to take out."""
    line = "only on this page there are words " * 48
    return [f"Home page\n{i} {line}\n" if i % 10 else None if i % 20 else f"{i} home Page" for i in range(n)]


def test_lines_are_cut_in_small_pieces():
    texts = _pages()
    data = np.frombuffer(b"Home page", np.uint8)
    line = quality_rules.measure(data, np.array([0, len(data)]))["line"].view(np.int64).tolist()
    cuts = [line if t and t.startswith("Home") else None if i % 3 else [] for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array(texts), pa.array(cuts, pa.list_(pa.int64()))],
        names=["doc_id", "text", "__cut_lines"],
    )
    parts = list(quality_rules._cut_batches(iter([batch, batch.slice(0, 0), batch.slice(7, 1)])))
    found = [t for p in parts for t in p.column("text").to_pylist()]
    assert [k for p in parts for k in p.column("doc_id").to_pylist()] == [*range(len(texts)), 7]
    expected = [t and t.removeprefix("Home page\n") for t in texts]
    assert found == [*expected, expected[7]]
    assert max(p.nbytes for p in parts) < 2 * text.CHUNK_BYTES < batch.nbytes


def test_secrets_are_redacted_in_small_pieces():
    texts = _pages()
    spans = [[{"kind": "hex", "start": 2, "end": 6}] if t and i % 10 == 1 else None for i, t in enumerate(texts)]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(texts), pa.array(range(len(texts))), pa.array(spans, kind)], names=["text", "doc_id", "__spans"]
    )
    parts = list(secrets._redact_batches(iter([batch, batch.slice(0, 0)])))
    assert [k for p in parts for k in p.column("doc_id").to_pylist()] == list(range(len(texts)))
    expected = [f"{t[:2]}[secret]{t[6:]}" if s else t for t, s in zip(texts, spans)]
    assert [t for p in parts for t in p.column("text").to_pylist()] == expected
    assert max(p.nbytes for p in parts) < 2 * text.CHUNK_BYTES < batch.nbytes


def test_ids_are_gathered_in_small_pieces(reader):
    texts = [None, "", " one two ", "x " * 700, *("some plain words here, " * 100 for _ in range(1500)), "", None]
    seen = []
    for first, ids, bounds in tokens.encode_texts(pa.array(texts, pa.string()), tokens.tokenizer_path()):
        assert first == len(seen) and bounds[0] == 0 and bounds[-1] == len(ids)
        assert len(ids) < 1_000_000
        seen += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    by_text = {t: reader.encode(t or "", add_special_tokens=False).ids + [1] for t in set(texts)}
    assert seen == [by_text[t] for t in texts]
    assert sum(map(len, seen)) > 600_000
