"""Token alignment against whole-text encoding, and the perfect hash against a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from demandlake.llm import cross_tokenizer, tokens
from demandlake.llm.perfect_hash import PerfectHash

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

ODD = [
    " leading", "trailing ", "  two  spaces ", "\nline\n\n lines \n", "tab\there\r\nnext\x0bcell", "a\xa0 b　 c  d\x85 e",
    "in ▁ the text", "▁", "<0x41> <s> <unk> <|endoftext|> 's don't", "  ", "\n", " ", "\x00 zero", "é ü ñ 漢字 かな 한글 \U0001f600\U0001f469‍\U0001f680 done",
    "x" * 5000, "1234567890 " * 50, "fi ﬁ é  thin   m   o   n", "];\r\n}\r\n", "end.\n\nNext: \"quoted\" text” (more) — so",
    " ", "a \nb", "café\n naïve à\n", "\x1c \x1d x", "\x7f y \u0080 z",
]


def plain(rows):
    a_model = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    own = {letter: byte for byte, letter in tokens.byte_letters().items()}
    found, counts = [], Counter()
    for key, text in rows:
        groups, links, a, b = [], [], [], []
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            a_raw = [bytes(own[c] for c in a_model.id_to_token(i)) for i in a]
            b_raw = [
                bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i)
                else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b
            ]
            if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
                a, b = [], []
        if a:
            a_ends, b_ends = np.cumsum([len(r) for r in a_raw]).tolist(), np.cumsum([len(r) for r in b_raw]).tolist()
            both = sorted(set(a_ends) & set(b_ends))
            for first, end in zip([0, *both], both):
                mine = [",".join(str(i) for i, e in zip(ids, ends) if first < e <= end)
                        for ids, ends in ((a, a_ends), (b, b_ends))]
                groups.append("|".join(mine))
            place = 0
            for i, end in enumerate(a_ends):
                begin = a_ends[i - 1] if i else 0
                while place and b_ends[place - 1] > begin:
                    place -= 1
                while b_ends[place] <= begin:
                    place += 1
                j = place
                while j < len(b) and (b_ends[j - 1] if j else 0) < end:
                    links.append((a[i], b[j]))
                    j += 1
        counts.update(links)
        found.append((key, a, b, groups, links))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return Counter(
        (key, len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links),
         sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for key, a, b, groups, links in found
    )


def found(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def texts(rows):
    short = [(d, t if t is None else t[:20_000]) for d, t in rows]
    return short + list(enumerate(ODD, start=1000))


SCHEMA = "doc_id long, text string, n_a string, pair int, shard int"


def test_alignment(spark, texts):
    frame = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in texts], SCHEMA).repartition(4)
    expected = plain(texts)
    assert found(cross_tokenizer.align_tokenizers(frame)) == expected
    # Many small shards, looked up in rounds.
    assert found(cross_tokenizer.align_tokenizers(frame, shard_pairs=300, round_shards=3)) == expected


def test_repeated_null_and_empty(spark, frame, empty):
    rows = [(1, "same text"), (1, "same text"), (None, "same words"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(cross_tokenizer.align_tokenizers(df)) == plain(rows)
    none = cross_tokenizer.align_tokenizers(empty)
    assert none.count() == 0 and tuple(none.columns) == COLUMNS
    assert cross_tokenizer.align_tokenizers(df.filter("doc_id = 2")).collect()[0]["groups_sha256"] == ""


def test_units_are_encoded_as_in_the_whole_text():
    """Random mixes of awkward characters, unit by unit and whole."""
    rng = random.Random(2)
    signs = [" ", " ", "\n", "\r", "\t", "a", "the", "é", "\xa0", "　", " ", "'s", "1", ".", "\x1f", "漢", ";", " ", "}"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 40)))) for i in range(3000)]
    aligner = cross_tokenizer.Aligner(*(tokens.tokenizer_path(p) for p in (
        cross_tokenizer.BYTE_TOKENIZER, cross_tokenizer.PIECE_TOKENIZER)))
    assert aligner.cuts
    import pyarrow as pa

    run = cross_tokenizer.Run(pa.array([t for _, t in rows], pa.large_string()), aligner)
    assert len(run.unit) > 2 * len(rows)
    mine = [b"".join(aligner.groups[u] for u in run.unit[a:b])[:-1] for a, b in zip(run.first, run.first[1:])]
    shas = Counter((k, hashlib.sha256(g).hexdigest()) for (k, _), g in zip(rows, mine))
    assert shas == Counter((r[0], r[-1]) for r in plain(rows))


def test_units_met_often_outlast_the_others(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cross_tokenizer, "KEPT_UNITS", 40)
    aligner = cross_tokenizer.Aligner(*(tokens.tokenizer_path(p) for p in (
        cross_tokenizer.BYTE_TOKENIZER, cross_tokenizer.PIECE_TOKENIZER)))
    rng = random.Random(3)
    for turn in range(12):
        rows = [(i, f"often met words ▁ {rng.randrange(10**9)} and é{rng.randrange(10**9)}") for i in range(9)]
        rows = [(i, t.replace("▁ ", "") if i % 4 else t) for i, t in rows]
        run = cross_tokenizer.Run(pa.array([t for _, t in rows], pa.large_string()), aligner)
        assert len(aligner) < 80
        expected = {r[0]: r for r in plain(rows)}
        n_a, n_b, n_groups = (run.sums(np.array(v)) for v in (aligner.n_a, aligner.n_b, aligner.n_groups))
        for i, _ in rows:
            assert (n_a[i], n_b[i], n_groups[i]) == expected[i][1:4]
            if run.live[i]:
                units = run.unit[run.first[i]:run.first[i + 1]]
                text = b"".join(aligner.groups[u] for u in units)[:-1]
                assert hashlib.sha256(text).hexdigest() == expected[i][-1]
                assert len(aligner.links_of(units)[0]) == expected[i][4]
    assert aligner.generation > 1


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 20_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 62, n + n // 10, dtype=np.uint64))[:n]
    hashed = PerfectHash.from_bytes(PerfectHash.of(keys).to_bytes())
    assert sorted(hashed(keys).tolist()) == list(range(len(keys))) and hashed.size == len(keys)
    assert len(hashed.to_bytes()) < 64 + 2 * len(keys)


def test_perfect_hash_needs_distinct_keys():
    with pytest.raises(ValueError):
        PerfectHash.of(np.array([5, 5], np.uint64))
