"""Operators against their plain versions, and on edge inputs."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.llm import (
    decontamination, language_model, matrices, near_dedup, packing, quality_rules, secrets,
    sharding, substring_dedup, suffix_dedup, tokens,
)


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def same(df, names, expected):
    assert collected(df, "doc_id", *names) == sorted(expected, key=repr)


def test_suffix_dedup(frame, rows):
    found = suffix_dedup.remove_repeated_bytes(frame).cache()
    same(found, ("n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.suffix_dedup(rows))
    for r in found.collect():
        if "\ufffd" not in r["kept_text"]:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
            assert len(r["kept_text"].encode()) == r["n_bytes"] - r["n_removed"]


def test_substring_dedup(frame, rows):
    same(substring_dedup.remove_repeats(frame), ("n_words", "n_removed", "kept_sha256"),
         brute.substring_dedup(rows))


def test_substring_dedup_joins_shared_windows_only(frame, monkeypatch):
    """Windows that no other document has are dropped before the second join moves them."""
    filtered = []
    real = substring_dedup.only_keys
    monkeypatch.setattr(
        substring_dedup, "only_keys", lambda df, key, wanted: (filtered.append(df.columns), real(df, key, wanted))[1]
    )
    substring_dedup.remove_repeats(frame)
    assert filtered == [["hash", "doc_id", "reference"], ["doc_id", "hash"]]


def test_substring_dedup_of_any_keys(spark, rows):
    """Texts as keys, and numbers near the ends of a long."""
    for name in (lambda d: f"k{d:03}", lambda d: (d - 20) * (1 << 58)):
        renamed = [(name(d), t) for d, t in rows[:25]]
        df = spark.createDataFrame(renamed, ["doc_id", "text"]).repartition(3)
        same(substring_dedup.remove_repeats(df), ("n_words", "n_removed", "kept_sha256"), brute.substring_dedup(renamed))


def test_near_dedup(frame, rows):
    same(near_dedup.near_duplicates(frame), ("n_shingles", "component_id", "kept"), brute.near_dedup(rows))


def test_quality_counts(frame, rows):
    same(quality_rules.judge(frame), (*quality_rules.COUNTS, "base_failed"), brute.quality(rows))


def test_secrets(spark, frame, rows, tmp_path):
    ledger = str(tmp_path / "ledger")
    found = secrets.find_secrets(frame, ledger)
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found.collect()}
    for d, n_assign, n_access, n_hex, sha in brute.secrets(rows):
        base = [s for s in spans[d] if s[0] in secrets.BASE_KINDS]
        assert Counter(s[0] for s in base) == +Counter(assign=n_assign, access=n_access, hex=n_hex)
        assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest() == sha
    # A second run finds nothing unseen, a new version of one text is one blob more.
    book = secrets.BlobLedger(spark, ledger)
    assert book.update(secrets.blobs(frame)).count() == 0
    more = frame.limit(1).withColumn("text", F.lit("token: abcdefgh1"))
    assert book.update(secrets.blobs(frame.union(more))).count() == 1
    clean = {r["doc_id"]: r for r in secrets.redact_secrets(frame).collect()}
    last = rows[-1][0]
    assert clean[last]["text"] == "[secret]' [secret] [secret] api-key: x"
    assert clean[last]["n_chars"] == len(clean[last]["text"])
    assert all(clean[d]["text"] == t for d, t in rows if not spans[d])


def test_language_model_base(frame, rows):
    scored = language_model.score_documents(frame).withColumn("base_score", F.round("base_score", 6))
    same(scored, ("held_out", "n_tokens", "n_known", "train_tokens", "base_score"), brute.unigram(rows))
    assert all(r["score"] < 0 for r in scored.collect())


def test_language_model_beats_base(spark, sf_dir):
    scored = language_model.op6_hashed_maxent_scores(spark, "/root/testdata/sf0.01")
    held = scored.filter("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("model")).first()
    assert held["model"] > held["base"]


def test_class_softmax_sums_to_one():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(language_model.FEATURE_ROWS, language_model.CLASSES)).astype(np.float32)
    rows = rng.integers(0, language_model.FEATURE_ROWS, (50, 4))
    p = language_model._probabilities(weights, np.zeros(language_model.CLASSES, np.float32), rows)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_places_and_words_sum_to_one():
    """Over the leaves of each tree, whatever the weights and the context."""
    rng = np.random.default_rng(1)
    forest = language_model.Forest(rng.random(60) + 0.1, np.array([0, 0, 1, 20, 60]))
    weights = rng.normal(size=1 << 10).astype(np.float32)
    context = np.repeat(rng.integers(0, 1 << 32, (1, 2), dtype=np.uint32), 60, axis=0)
    p = np.exp(forest.logs(weights, context, np.arange(60)))
    assert np.allclose([p[:1].sum(), p[1:20].sum(), p[20:].sum()], 1, atol=1e-5)
    # A bucket: its seven words, learnt in two contexts, and an unseen one in one of them.
    words = np.concatenate((rng.integers(0, 7, 5000), np.arange(8))).astype(np.uint64)
    contexts = np.repeat((words % 2)[:, None], 2, axis=1).astype(np.uint32) << 20
    contexts[-8:] = contexts[0]
    learn = np.arange(len(words)) < 5000
    counts, gain = language_model.score_bucket(learn, words, contexts)
    assert counts[-8:].tolist() == [*np.bincount(words[:5000].astype(int)), 0]
    assert np.isclose(np.exp(gain[-8:]).sum(), 1, atol=1e-4)
    odd = words[-8:-1] % 2 == words[0] % 2
    assert np.exp(gain[-8:-1])[odd].sum() > 0.75  # 4 of 7 without context


def test_updates_add_up_like_plain_ones():
    """A step in which rows are met often, and by several features and nodes, one by one."""
    rng = np.random.default_rng(3)
    rows, kinds = rng.integers(0, 40, (300, 4)), rng.integers(0, 8, 300)
    rows[:, 1] = rng.integers(0, 3, 300)
    weights = rng.normal(size=(40, 8)).astype(np.float32)
    squares, uses, prior = np.ones_like(weights), np.zeros(40, np.float32), np.zeros(8, np.float32)
    total = np.zeros((40, 8))
    for row, kind in zip(rows, kinds):
        p = np.exp(weights[row].sum(axis=0))
        for r in row:
            total[r] += p / p.sum() - (np.arange(8) == kind)
    plain = weights - language_model.RATE * total / np.sqrt(2 + total**2)
    language_model.update(weights, squares, uses, prior, rows, kinds)
    assert np.allclose(weights, plain, atol=1e-4) and np.allclose(squares, 1 + total**2, rtol=1e-3)
    assert uses.tolist() == np.bincount(rows.ravel(), minlength=40).tolist()

    forest = language_model.Forest(rng.random(30) + 0.1, np.array([0, 1, 12, 30]))
    size, leaves = 1 << 5, rng.integers(0, 30, 200)
    contexts = rng.integers(0, 1 << 32, (200, 2), dtype=np.uint32)
    pairs = rng.normal(size=size).astype(np.complex64)
    old = pairs.real.astype(float)
    total = np.zeros(size)
    for context, leaf in zip(contexts, leaves):
        _, met, sides, odds = forest.decide(size, context[None], np.array([leaf]))
        slope = 1 / (1 + np.exp(-(odds + old[met].sum(axis=0)))) - sides
        for row in met:
            np.add.at(total, row, slope)
    forest.update(pairs, contexts, leaves)
    assert np.allclose(pairs.imag, total**2, rtol=1e-3, atol=1e-4)
    assert np.allclose(pairs.real, old - language_model.RATE * total / np.sqrt(1 + total**2), atol=1e-4)


def test_crowded_words_are_looked_up(spark):
    """Placed words with equal first bits, and others that have them, get their own counts."""
    tokens = (np.array([5, 5, 5, 9, 1 << 16], np.uint64) << np.uint64(47)) + np.arange(5, dtype=np.uint64)
    counts = spark.createDataFrame([(int(t), i + 1) for i, t in enumerate(tokens.view(np.int64))], "token long, n long")
    words = language_model.Vocabulary(counts)
    unseen = np.array([5, 9, 7, (1 << 17) - 1], np.uint64) << np.uint64(47)
    unseen += np.uint64(77)
    found = words.look_up(np.concatenate((tokens, unseen)))[2]
    assert found.tolist() == [1, 2, 3, 4, 5, 0, 0, 0, 0]


def test_rare_words_have_context(spark, monkeypatch):
    """Words that their predecessor tells, too rare for a place: their score follows it."""
    monkeypatch.setattr(language_model, "PLACED", 100, raising=False)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"a{i} b{i}" for i in rng.integers(0, 400, 25)) for _ in range(1500)]
    # Held out: the same words, told by their predecessors or not.
    held = [i for i in range(100_000) if zlib.crc32(str(i).encode()) % 10 == 0][-200:]
    order = rng.permutation(400)
    for i, d in enumerate(held):
        pairs = rng.integers(0, 400, 25)
        texts.append(" ".join(f"a{i} b{i}" if d % 2 else f"a{i} b{order[i]}" for i in pairs))
    learnt = [i for i in range(100_000) if zlib.crc32(str(i).encode()) % 10][:1500]
    df = spark.createDataFrame(list(zip(learnt + held, texts)), "doc_id long, text string")
    told = F.col("doc_id") % 2 == 1
    scored = language_model.score_documents(df).filter("held_out").groupBy(told.alias("told")).agg(
        (F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).alias("gain")
    )
    gain = {r["told"]: r["gain"] for r in scored.collect()}
    assert gain[True] > 0.75


def draw(key, label):
    return (int(hashlib.md5(f"{key}:{label}".encode()).hexdigest()[:13], 16) + 1) / (16.0**13 + 1)


def test_sharding(frame, rows):
    found = {r["doc_id"]: r for r in sharding.assign_shards(frame).collect()}
    slots = defaultdict(list)
    for d, t in rows:
        r = found[d]
        raw = (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == max(range(16), key=lambda i: draw(d, i))
        assert r["grown_shard"] == max(range(17), key=lambda i: draw(d, i))
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    found = sharding.assign_shards(keys, 2, [3.0, 1.0, 1.0]).collect()
    share = sum(r["shard"] == 0 for r in found) / 4000
    assert abs(share - 0.75) < 0.04
    assert abs(sum(r["grown_shard"] == 2 for r in found) / 4000 - 0.2) < 0.04


def expected_ids(rows):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(tokens.tokenizer_path())
    return {d: reader.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}


def test_packing(frame, rows):
    ids = expected_ids(rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(frame).collect():
        mine = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(np.array(mine, "<u4").tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, mine in pieces.items():
        at = 0
        for start, length in sorted(mine):
            assert start == at
            at += length
        assert at == len(ids[d])
    assert set(pieces) == set(ids) and sorted(sequences) == list(range(len(sequences)))
    for mine in sequences.values():
        at = 0
        for offset, length in sorted(mine):
            assert offset == at
            at += length
        assert at <= 2048


def test_patterns_are_near_optimal():
    rng = np.random.default_rng(3)
    demand = rng.integers(0, 60, 64)
    plan = packing.make_plan(demand, 64)
    weight = int((demand * np.arange(1, 65)).sum())
    assert plan.sequences <= -(-weight // 64) * 1.05 + 2
    assert packing.make_plan(np.zeros(64, int), 64).sequences == 0


def test_matrix(frame, rows):
    ids = expected_ids(rows)
    matrix = matrices.packed_matrix(frame, group_bytes=1 << 16)
    back = defaultdict(dict)
    for r in matrices.unpack_matrix(matrix).collect():
        back[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u2").tolist()
    joined = {d: [i for s in sorted(p) for i in p[s]] for d, p in back.items()}
    assert joined == ids
    for r in matrix.collect():
        assert len(r["ids"]) == 2 * matrices.CAPACITY and r["cu_seqlens"][-1] == r["n_tokens"]
        assert r["position_resets"] == r["cu_seqlens"][:-1]


def test_best_fit_matches_a_plain_search():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 400)
    rooms, rows = [], np.empty(400, int)
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(room, -row) for row, room in enumerate(rooms) if room >= lengths[i]]
        row = -min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(100)
        rooms[row] -= lengths[i]
        rows[i] = row
    found = matrices.best_fit_decreasing(lengths, 100)
    assert found.max() + 1 == len(rooms)
    assert np.bincount(found, lengths).max() <= 100


ITEM = "Anna walked 12 km to the market and bought 5 apples , then Anna walked 12 km back home again"


@pytest.mark.parametrize("text, hit", [
    (f"some words before it. {ITEM} and after", True),
    (ITEM.lower(), True),  # the stretch between the names is the item's own
    (ITEM.replace("Anna", "Boris").replace("12", "30").replace("km", "miles"), True),
    (ITEM.replace("12", "30", 1).replace("5", "6"), False),  # 12 became 30, and stayed 12
    (ITEM.replace("Anna walked 12", "Then"), True),  # a verbatim stretch of the item
    ("walked to the market and bought apples", False),
    (None, False), ("", False),
])
def test_decontamination(spark, text, hit):
    docs = spark.createDataFrame([(7, text), (8, "nothing to see here at all today my friend")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (3, "")], "item_id long, text string")
    found = collected(decontamination.contaminated(docs, items), "doc_id", "item_id")
    assert found == ([(7, 1)] if hit else [])


def test_short_items_match_whole(spark):
    docs = spark.createDataFrame([(1, "here one two three four five six there"), (2, "one two three four five")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "one two")], "item_id long, text string")
    assert collected(decontamination.contaminated(docs, items), "doc_id", "item_id") == [(1, 1)]


SHOUT = "Which river runs past the old mill before it meets the sea near the town"


@pytest.mark.parametrize("item, text, hit", [
    (SHOUT, f"THIS IS ALL LOUD . {SHOUT.upper()} . AND MORE", True),
    (SHOUT.title(), f"quiet words {SHOUT.lower()} and more", True),
    (SHOUT, " ".join(SHOUT.upper().split()[:13]), True),
    (SHOUT, " ".join(SHOUT.upper().split()[:12]), False),
    ("3 1 4 1 5 9 2 6 5 3 5 8 9 7 9 3", "digits 3 1 4 1 5 9 2 6 5 3 5 8 9 7 9 3 of pi", True),
    ("3 1 4 1 5 9 2 6 5 3 5 8 9 7 9 3", "digits 2 7 1 8 2 8 1 8 2 8 4 5 9 0 4 5 of e", False),
    ("One Two Three Four Five Six", "here ONE TWO THREE FOUR FIVE SIX there", True),
    ("One Two Three Four Five Six Seven Eight Nine Ten", "one two three four five six seven eight nine ten", True),
    ("One Two Three Four Five Six Seven Eight Nine Ten", "one two three four five six seven eight nine", False),
])
def test_verbatim_whatever_the_case(spark, item, text, hit):
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = collected(
        decontamination.contaminated(docs, items), "doc_id", "item_id", "n_slots", "verbatim"
    )
    assert found == ([(7, 1, 0, True)] if hit else [])


def test_matrix_of_wide_ids_repeated_rows_and_null_keys(spark, repeated, monkeypatch):
    narrow = matrices.packed_matrix(repeated)
    monkeypatch.setattr(matrices, "id_width", lambda path: 4)
    wide = matrices.packed_matrix(repeated)
    pieces = [
        sorted((repr(r["doc_id"]), r["start"], np.frombuffer(r["ids"], dtype).tolist()) for r in unpacked.collect())
        for unpacked, dtype in ((matrices.unpack_matrix(narrow), "<u2"), (matrices.unpack_matrix(wide, 4), "<u4"))
    ]
    assert pieces[0] == pieces[1] and len(pieces[0]) == 6
    assert sum(key == "None" for key, _, _ in pieces[0]) == 2
    assert {r["ids_crc32"] for r in narrow.collect()} == {r["ids_crc32"] for r in wide.collect()}


def test_boilerplate_lines(spark):
    import random

    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    menu = [text(9) for _ in range(6)]
    page = "\n".join(text(12) for _ in range(8))
    docs = [(i, "\n".join([text(60), menu[0], text(20)]), "a") for i in range(40)]
    docs += [(200 + i, page, "a") for i in range(40)]  # copies of one page are no boilerplate
    body = lambda: [text(10) for _ in range(20)]
    docs += [(300 + i, "\n".join([*body(), *rng.sample(menu, 5)]), "a") for i in range(60)]
    docs += [(400 + i, "\n".join([*rng.sample(menu, 6), text(9)]), "a") for i in range(3)]
    docs += [(500, "\n".join([text(60), menu[0]]), "b"), (501, None, None), (502, "\n".join([text(60), menu[0]]), None)]
    docs += [(600 + i, "\n".join([text(55), menu[1].upper()]), None) for i in range(25)]  # another null host's
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert {d: (r["kept"], r["n_left"]) for d, r in found.items()} == brute.boilerplate(docs)
    assert all(found[i]["kept"] and len(found[i]["cut_lines"]) == 1 for i in range(40))
    assert all(found[200 + i]["kept"] and not found[200 + i]["cut_lines"] for i in range(40))
    assert all(found[400 + i]["depleted"] and not found[400 + i]["kept"] for i in range(3))
    assert found[500]["kept"] and not found[500]["cut_lines"]
    cleaned = {r["doc_id"]: r["text"] for r in quality_rules.clean(df).collect()}
    assert menu[0] not in cleaned[0] and cleaned[200] == page and 400 not in cleaned


@pytest.mark.parametrize("fixed, own", [(1, 3), (6, 3), (10, 1), (20, 3)])
def test_lines_of_all_pages_of_a_host(spark, fixed, own):
    """Pages of fixed lines and a few lines of their own lose the fixed ones; pages that are
    little else go."""
    import random

    rng = random.Random(fixed)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    chrome = [text(12) for _ in range(fixed)]
    docs = [(i, "\n".join([*chrome, *(text(20) for _ in range(own))]), "h") for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    found = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert sum(len(r["cut_lines"]) for r in found.values()) == 500 * fixed
    assert {d: (r["kept"], r["n_left"]) for d, r in found.items()} == brute.boilerplate(docs)
    assert all(r["kept"] == (own == 3) for r in found.values())


def test_verdict_on_a_line_does_not_follow_the_size_of_its_host(spark):
    """A line of three in a hundred documents stays, on a host of 200 and of 2,000."""
    for n in (200, 2000):
        docs = [(i, f"p{i} " * 5 + "\n" + ("and so on" if i % 33 == 0 else f"q{i}"), "h") for i in range(n)]
        df = spark.createDataFrame(docs, "doc_id long, text string, source string")
        assert quality_rules.judge(df).filter("size(cut_lines) > 0").count() == 0


OPERATORS = {
    "suffix": suffix_dedup.remove_repeated_bytes, "substring": substring_dedup.remove_repeats,
    "sharding": sharding.assign_shards, "packing": packing.pack, "matrix": matrices.packed_matrix,
    "model": language_model.score_documents, "near": near_dedup.near_duplicates,
    "near drop": near_dedup.drop_near_duplicates, "quality": quality_rules.judge,
    "quality drop": quality_rules.clean, "secrets": secrets.find_secrets,
    "redact": secrets.redact_secrets,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("matrix", "quality drop")])
def test_repeated_and_null_keys(repeated, name):
    n = OPERATORS[name](repeated).count()
    # The second document's only near copy comes first.
    assert n == (5 if name == "near drop" else 6)


def test_decontamination_of_nothing(spark, frame, empty, repeated):
    none = spark.createDataFrame([], "item_id long, text string, hash int")
    some = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    assert decontamination.contaminated(frame, none).count() == 0
    assert decontamination.contaminated(empty, some).count() == 0
    assert decontamination.drop_contaminated(repeated, some).count() == 6
    assert decontamination.drop_contaminated(frame, some).columns == frame.columns


def test_near_copies_around_one_page(spark, monkeypatch):
    """Copies with few and many changes: some meet the page, some only one another."""
    import random

    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(146)]
    docs = [(0, " ".join(base))]
    for i in range(1, 90):
        words = list(base if i % 3 else docs[i - 1][1].split())
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute.near_dedup(docs)
    assert 1 < sum(r[-1] for r in expected) < 89
    for block in (near_dedup.BLOCK, 7):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        same(near_dedup.near_duplicates(df), ("n_shingles", "component_id", "kept"), expected)


def licence_pages(n, seed=3):
    """Documents that share a passage of two fifths of their shingles and nothing else."""
    import random

    rng = random.Random(seed)
    licence = " ".join(f"l{rng.randrange(10**6)}" for _ in range(120))
    return [(i, " ".join(f"p{rng.randrange(10**6)}" for _ in range(84)) + " " + licence) for i in range(n)]


def test_pages_with_a_licence_are_not_compared_with_all_others(spark, monkeypatch):
    """Sketches of such pages meet in few buckets, and hardly a pair has its sets fetched."""
    fetched = []
    real = near_dedup.shingle_sets_of

    def counted(docs, classes, names):
        fetched.append(names.count())
        return real(docs, classes, names)

    monkeypatch.setattr(near_dedup, "shingle_sets_of", counted)
    for n in (300, 600):
        fetched.clear()
        df = spark.createDataFrame(licence_pages(n), "doc_id long, text string").repartition(4)
        assert near_dedup.near_duplicates(df).filter("kept").count() == n
        assert len(fetched) == 2 and sum(fetched) <= n // 20


def test_recall_of_the_bands():
    """Pairs at the threshold that share no band: about two in a million."""
    one = 0.75 ** near_dedup.ROWS
    assert (1 - one) ** near_dedup.BANDS < 4e-6
    rng = np.random.default_rng(0)
    missed = below = 0
    for _ in range(300):
        union = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        shared, rest = union[:300], union[300:]
        a, b = np.concatenate([shared, rest[:50]]), np.concatenate([shared, rest[50:]])
        sketches = np.stack([near_dedup.registers(a), near_dedup.registers(b)])
        keys = near_dedup.band_keys(sketches)
        missed += not (keys[0] == keys[1]).any()
        n = np.array([len(a)]), np.array([len(b)])
        below += near_dedup.estimate(sketches[:1], sketches[1:], *n)[0] < near_dedup.LEAST_ESTIMATE
        assert (sketches[0] == sketches[1]).sum() >= near_dedup.LEAST_EQUAL
    assert missed == below == 0
