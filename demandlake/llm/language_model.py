"""A hashed maximum-entropy language model, factored by class, place and word.

A token's probability is that of its class given the tokens before it, times that of its
place in the class, times that of the word in its bucket; all three factors are trained.
The class softmax has one row of weights per hashed n-gram or skip feature. A place is one
of the most common words or a bucket of rarer ones, and is reached by yes-no decisions down
a binary tree; so is a word in its bucket, whose tree ends in the words of the bucket and
one unseen word. Every decision is a logistic model with one weight per hashed n-gram
feature and the log ratio of the smoothed counts below it as prior, so the places of a class
and the words of a bucket each sum to one.

Counts come from all training documents. Class and place weights are trained by gradient
updates in every map task at once: each round covers its own part of the training documents,
and the tasks' weights are averaged, weighted by how often or how far a task moved them.
The tokens of the buckets are shuffled by bucket, and each bucket trains its own weights on
all its training tokens before it scores. The buckets grow in number with the tokens of the
corpus, and the weights of each with its tokens.

A task's memory follows the class and place weights, which are of fixed size, and the tokens
of one bucket: about ``BUCKET_TOKENS``, or those of the rarer words' most common one, which
is at most one in ``PLACED + 1`` of all tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from demandlake.llm import text as T
from demandlake.llm.tables import stage, table, text_or_empty

FOLDS = 10
SMOOTHING = 0.1
CLASSES = 32
OWN_CLASSES = 16  # the most common words have a class each
PLACED = 1 << 13  # the most common words have a class or a place of their own
BUCKET_TOKENS = 1 << 21
LEAST_BUCKETS = 4  # of each hashed class
FEATURE_ROWS = 1 << 14
PLACE_BITS = 20
TREE_FEATURES = 2  # the trees look one token back and two together
ROUNDS = 2
STEP = 4096  # tokens per gradient update
RATE = 0.5
OFTEN = 16  # meetings of a row in a step that are added for all rows at once
BLOCK_ROWS = 256
PLACE_BLOCKS = 64
MERGE = 64  # partial weights merged at a time

END_HASH = np.uint64(0x9D5C_30F1_6E2A_4B77)
# The token before a text, and the seeds of the features that look one token back, two
# together, two back and three back.
_START = np.uint64(0x1F83_D9AB_FB41_BD6B)
_PREFIX = np.uint64(64 - 17)
_SEEDS = T.mix(np.arange(11, 15, dtype=np.uint64))


def held_out(doc_id):
    """Whether ``crc32(doc_id as text) mod FOLDS`` is 0; a null key counts as empty text."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(name) % FOLDS == 0


def token_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, tokens, bounds)`` for runs of texts: hashes of the lower-cased words of
    each text and its end."""
    for first, end, data, offsets in T.chunks(column):
        words = T.words(data, offsets, lower=True)
        tokens = np.insert(words.hashes, words.first[1:], END_HASH)
        yield first, end, tokens, words.first + np.arange(end - first + 1)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts, added up over a batch before they are shuffled."""
    for batch in batches:
        tokens = [t for _, _, t, _ in token_runs(batch.column("text"))]
        if not tokens:
            continue
        hashes, counts = np.unique(np.concatenate(tokens), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["token", "n"]
        )


def token_counts(train: DataFrame) -> DataFrame:
    """How often each token (by hash) occurs in ``train``."""
    counted = train.select("text").mapInArrow(_count_batches, "token long, n long")
    return stage(counted.groupBy("token").agg(F.sum("n").alias("n")), "token-counts")


_DECISION = np.dtype([("key", "u4"), ("prior", "f4"), ("side", "f4"), ("unused", "f4")])


class Forest:
    """Binary trees over leaves in order, one for each run of leaves. Every split leaves the
    two sides as near in mass as that order allows."""

    def __init__(self, mass: np.ndarray, bounds: np.ndarray):
        below = np.concatenate(([0.0], np.cumsum(mass)))
        low, high = bounds[:-1], bounds[1:]
        levels, count = [], 0
        while True:
            split = high - low > 1
            low, high = low[split], high[split]
            if not len(low):
                break
            middle = np.clip(np.searchsorted(below, (below[low] + below[high]) / 2), low + 1, high - 1)
            prior = np.log((below[high] - below[middle]) / (below[middle] - below[low]))
            keys = T.mix(np.arange(count + 1, count + len(low) + 1, dtype=np.uint64)) >> np.uint64(32)
            levels.append((low, high, middle, prior, keys))
            count += len(low)
            low, high = np.concatenate((low, middle)), np.concatenate((middle, high))
        steps = np.zeros(len(mass) + 1, np.int64)
        for low, high, *_ in levels:
            steps[low] += 1
            np.subtract.at(steps, high, 1)
        # What the decisions of a leaf need lies side by side, from the root on.
        self.depth = np.cumsum(steps[:-1])
        self.first = np.cumsum(self.depth) - self.depth
        self.path = np.empty(int(self.depth.sum()), _DECISION)
        for level, (low, high, middle, prior, keys) in enumerate(levels):
            owner, leaf = _ranges(low, high - low)
            at = self.first[leaf] + level
            self.path["key"][at] = keys.astype(np.uint32)[owner]
            self.path["prior"][at] = prior.astype(np.float32)[owner]
            self.path["side"][at] = leaf >= middle[owner]

    def decide(self, size: int, contexts: np.ndarray, leaves: np.ndarray):
        """For the decisions on the way to each leaf: how many they are, their rows among
        ``size`` weights, the side to take, and the prior log odds of the second side."""
        depth = self.depth.take(leaves)
        path = self.path.take(_laid(self.first.take(leaves), depth))
        shift = np.uint32(33 - size.bit_length())
        keys = path["key"].copy()
        rows = np.empty((contexts.shape[1], len(path)), np.int64)
        for i, row in enumerate(rows):
            row[:] = (contexts[:, i].repeat(depth) + keys) >> shift
        return depth, rows, path["side"].copy(), path["prior"].copy()

    def update(self, weights: np.ndarray, contexts: np.ndarray, leaves: np.ndarray) -> None:
        """One gradient update; ``weights`` are complex, with the sum of the squared slopes
        of each as imaginary part, so that both come from memory at once."""
        _, rows, sides, odds = self.decide(len(weights), contexts, leaves)
        if not len(odds):
            return
        # Weights are read and written in order, and a sum goes by the order of the tokens.
        bits = rows.size.bit_length()
        ranked = np.sort((rows.ravel() << bits) | np.arange(rows.size))
        place = ranked & ((1 << bits) - 1)
        ranked >>= bits
        again = ranked[1:] == ranked[:-1]
        held = weights.take(ranked)
        each = np.empty(rows.size, np.float32)
        each[place] = held.real
        for part in each.reshape(rows.shape):
            odds += part
        slope = (1 / (1 + np.exp(-odds)) - sides).view(np.float32)
        slope = np.tile(slope, len(rows)).take(place)
        first = np.flatnonzero(np.append(True, ~again))
        again = np.flatnonzero(again) + 1
        total = slope.take(first)
        np.add.at(total, again - np.arange(1, len(again) + 1), slope.take(again))
        held = held.take(first)
        held.imag += total * total
        held.real -= RATE * total / np.sqrt(held.imag + 1)
        weights[ranked.take(first)] = held

    def logs(self, weights: np.ndarray, contexts: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Log probability of each leaf in its tree."""
        depth, rows, sides, odds = self.decide(len(weights), contexts, leaves)
        for row in rows:
            odds += weights.take(row)
        odds *= 1 - 2 * sides
        losses = np.maximum(odds, 0) + np.log1p(np.exp(-np.abs(odds)))
        return -np.bincount(np.arange(len(leaves)).repeat(depth), losses, len(leaves))


def _ranges(first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whose each element of some ranges is, and the elements, laid end to end."""
    return np.repeat(np.arange(len(first)), lengths), _laid(first, lengths)


def _laid(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The elements of some ranges, laid end to end."""
    at = np.repeat(first - np.cumsum(lengths) + lengths, lengths)
    at += np.arange(len(at))
    return at


class Vocabulary:
    """Totals of the training tokens, the counts of the placed words, all classes and places."""

    def __init__(self, counts: DataFrame):
        row = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.tokens, self.distinct = row["n"] or 0, row["v"]
        hashed = CLASSES - OWN_CLASSES
        self.buckets = hashed * max(LEAST_BUCKETS, -(-self.tokens // (BUCKET_TOKENS * hashed)))
        placed = counts.orderBy(F.desc("n"), "token").limit(PLACED).toArrow()
        hashes = placed.column("token").to_numpy().view(np.uint64)
        n = placed.column("n").to_numpy()
        # Tokens and words of each bucket, without the placed ones.
        held = np.zeros((self.buckets, 2))
        bucket = F.pmod(F.shiftrightunsigned("token", 33), F.lit(self.buckets))
        for r in counts.groupBy(bucket.alias("bucket")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")
        ).collect():  # a row for every BUCKET_TOKENS tokens
            held[r["bucket"]] = r["n"], r["v"]
        np.subtract.at(held, self.bucket(hashes), np.stack([n, np.ones(len(n))], axis=1))
        # A smoothed place for each word, and one for an unseen word of each bucket.
        masses = np.concatenate((n + SMOOTHING, held[:, 0] + SMOOTHING * held[:, 1] + SMOOTHING))
        classes = np.concatenate((self.bucket(hashes), np.arange(self.buckets))) % hashed + OWN_CLASSES
        own = min(len(n), OWN_CLASSES)
        classes[:own] = np.arange(own)
        mass = np.bincount(classes, masses, CLASSES)
        mass[own:OWN_CLASSES] = SMOOTHING
        self.prior = np.log(mass / mass.sum()).astype(np.float32)
        order = np.lexsort((-masses, classes))
        self.forest = Forest(masses[order], np.searchsorted(classes[order], np.arange(CLASSES + 1)))
        leaf = np.empty(len(order), np.int64)
        leaf[order] = np.arange(len(order))
        by_hash = np.argsort(hashes)
        self.hashes, self.counts = hashes[by_hash], n[by_hash]
        # By their first bits, most tokens meet one placed word at most.
        prefix = (self.hashes >> _PREFIX).astype(np.int64)
        met = np.bincount(prefix, minlength=1 << 17)
        self.heads = np.minimum(np.cumsum(met) - met, max(len(hashes) - 1, 0))
        self.crowded = met > 1
        self.leaf_class = classes[order]
        self.placed_leaf, self.bucket_leaf = leaf[:len(n)][by_hash], leaf[len(n):]

    def bucket(self, tokens: np.ndarray) -> np.ndarray:
        return ((tokens >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and place of each token, and its count where it is placed (else 0)."""
        leaves = self.bucket_leaf[self.bucket(tokens)]
        counts = np.zeros(len(tokens), np.int64)
        if len(self.hashes):
            prefix = (tokens >> _PREFIX).view(np.int64)
            at = self.heads.take(prefix)
            crowded = np.flatnonzero(self.crowded.take(prefix))
            at[crowded] = np.minimum(np.searchsorted(self.hashes, tokens[crowded]), len(self.hashes) - 1)
            known = self.hashes.take(at) == tokens
            leaves = np.where(known, self.placed_leaf[at], leaves)
            counts = np.where(known, self.counts[at], 0)
        return self.leaf_class[leaves], leaves, counts


def features(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of class weights of each token's context, one column per feature, and the
    hashes of the features that the trees use."""
    before = []
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    for back in (1, 2, 3):
        earlier = np.empty(len(tokens), np.uint64)
        earlier[back:] = tokens[:-back] if back < len(tokens) else tokens[:0]
        earlier[place < back] = _START
        before.append(earlier)
    one, two, three = before
    mixed = np.stack([
        one + _SEEDS[0], T.mix(one + _SEEDS[1]) + two, two + _SEEDS[2], three + _SEEDS[3],
    ], axis=1)
    mixed = T.mix(mixed)
    contexts = (mixed[:, :TREE_FEATURES] >> np.uint64(32)).astype(np.uint32)
    return ((mixed >> np.uint64(20)) % np.uint64(FEATURE_ROWS)).view(np.int64), contexts


def _probabilities(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    scores = weights.take(rows[:, 0], axis=0)
    scores += prior
    for column in range(1, rows.shape[1]):
        scores += weights.take(rows[:, column], axis=0)
    # The greatest of a short row is found faster down the columns of a copy.
    scores -= scores.T.copy().max(axis=0)[:, None]
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def update(weights, squares, uses, prior, rows, kinds) -> None:
    """One gradient update from a run of tokens, with a rate that falls per weight."""
    # Unpickled arrays bring a type of their own, on which numpy's loops are slower.
    slope = _probabilities(weights, prior, rows).view(np.float32)
    slope[np.arange(len(kinds)), kinds] -= 1
    # Small numbers are sorted by their digits.
    flat = rows.ravel().astype(np.min_scalar_type(len(weights) - 1))
    order = np.argsort(flat, kind="stable")
    flat, token = flat.take(order), order // rows.shape[1]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    met = np.diff(first, append=len(flat))
    ranked = np.argsort((met.max() - met).astype(np.min_scalar_type(len(flat))), kind="stable")
    first, met = first.take(ranked), met.take(ranked)
    touched = flat.take(first)
    # The slopes of a row are added in the order of the tokens: those of its first meeting,
    # its second and so on for all rows at once, the rest of the few that are met often.
    more = len(met) - np.searchsorted(met[::-1], np.arange(OFTEN + 1), "right")
    total = slope.take(token.take(first), axis=0)
    for i in range(1, OFTEN):
        total[:more[i]] += slope.take(token.take(first[:more[i]] + i), axis=0)
    for i in range(more[OFTEN]):
        rest = slope.take(token[first[i] + OFTEN:first[i] + met[i]], axis=0)
        rest[0] += total[i]
        total[i] = rest.sum(axis=0)
    square = squares.take(touched, axis=0)
    square += total * total
    squares[touched] = square
    square += 1
    np.sqrt(square, out=square)
    total *= RATE
    total /= square
    weights[touched] = np.subtract(weights.take(touched, axis=0), total, out=total)
    uses[touched] += met


def _train_batches(shared, vocabulary):
    """One set of weights per task, in blocks, with how often each class row was used and
    how far each place weight was moved."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        weights, places = shared.value[0].copy(), shared.value[1].astype(np.complex64)
        squares = np.zeros_like(weights)
        uses = np.zeros(FEATURE_ROWS, np.float32)
        for batch in batches:
            for _, _, tokens, bounds in token_runs(batch.column("text")):
                kinds, leaves, _ = words.look_up(tokens)
                rows, contexts = features(tokens, bounds)
                steps = [slice(at, at + STEP) for at in range(0, len(tokens), STEP)]
                # One set of weights after the other, which then stays in the processor's cache.
                for part in steps:
                    update(weights, squares, uses, words.prior, rows[part], kinds[part])
                for part in steps:
                    words.forest.update(places, contexts[part], leaves[part])
        if not uses.any():
            return
        task = TaskContext.get().partitionId()
        for first, values, moved in (
            (0, weights * uses[:, None], uses),
            (FEATURE_ROWS // BLOCK_ROWS, places.real * places.imag, places.imag),
        ):
            blocks = len(moved) // BLOCK_ROWS if first == 0 else PLACE_BLOCKS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(first, first + blocks), pa.int32()),
                    pa.array([task] * blocks, pa.int64()),
                    pa.array([b.astype("<f4").tobytes() for b in np.split(values, blocks)], pa.binary()),
                    pa.array([b.astype("<f4").tobytes() for b in np.split(moved, blocks)], pa.binary()),
                ],
                names=["block", "task", "weights", "uses"],
            )

    return train


_PARTIAL = "block int, task long, weights binary, uses binary"


def _merge(pieces):
    """The sum of up to ``MERGE`` partial weights of one block."""
    row = {"block": [pieces["block"].iloc[0]], "task": [pieces["task"].iloc[0]]}
    for column in ("weights", "uses"):
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in pieces[column])
        row[column] = [total.astype("<f4").tobytes()]
    return type(pieces)(row)


def train_classes(train: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class and place weights after ``rounds`` rounds, each over its own part of ``train``."""
    spark = train.sparkSession
    words = spark.sparkContext.broadcast(vocabulary)
    weights = np.zeros((FEATURE_ROWS, CLASSES), np.float32)
    places = np.zeros(1 << PLACE_BITS, np.float32)
    # Four input partitions to a task: fewer sets of weights to write and to average.
    tasks = train.rdd.getNumPartitions()
    tasks = max(tasks // 4, min(tasks, 12))
    for i in range(rounds):
        shared = spark.sparkContext.broadcast((weights, places))
        part = train.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == i).select("text").coalesce(max(tasks, 1))
        pieces = stage(part.mapInArrow(_train_batches(shared, words), _PARTIAL), "partial-weights")
        most = pieces.agg(F.max("task").alias("t")).first()["t"]
        # Neighbouring tasks are merged MERGE at a time until one set is left.
        while most:
            merged = pieces.withColumn("task", F.floor(F.col("task") / MERGE)).groupBy("block", "task")
            pieces = stage(merged.applyInPandas(_merge, _PARTIAL), "partial-weights")
            most //= MERGE
        first = FEATURE_ROWS // BLOCK_ROWS
        blocks = {i: b for i, b in enumerate(np.split(weights, first) + np.split(places, PLACE_BLOCKS))}
        for row in pieces.collect():  # one row of each block
            block = blocks[row["block"]]
            uses = np.frombuffer(row["uses"], "<f4").reshape(-1, *[1] * (block.ndim - 1))
            sums = np.frombuffer(row["weights"], "<f4").reshape(block.shape)
            block[...] = np.where(uses > 0, sums / np.where(uses > 0, uses, 1), block)
    return weights, places


def _score_batches(shared, vocabulary, fields):
    """Per document: its tokens, the placed ones, the log counts of those, and the log10
    probabilities of classes and places. Per bucket and fold: the batch's tokens in it."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (weights, places) = vocabulary.value, shared.value
        task = TaskContext.get().partitionId()
        schema = to_arrow_schema(fields)
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            per_text, rare = [], []
            for first, end, tokens, bounds in token_runs(batch.column("text")):
                kinds, leaves, counts = words.look_up(tokens)
                rows, contexts = features(tokens, bounds)
                gain = np.empty(len(tokens))
                steps = [slice(at, at + STEP) for at in range(0, len(tokens), STEP)]
                for part in steps:
                    p = _probabilities(weights, words.prior, rows[part])
                    gain[part] = np.log10(p[np.arange(len(p)), kinds[part]])
                for part in steps:
                    gain[part] += words.forest.logs(places, contexts[part], leaves[part]) / math.log(10)
                placed = counts > 0
                logs = np.where(placed, np.log10(counts + SMOOTHING), 0)
                per_text.append((
                    np.diff(bounds), T.per_text(placed, bounds),
                    np.add.reduceat(logs, bounds[:-1]), np.add.reduceat(gain, bounds[:-1]),
                ))
                at = np.flatnonzero(~placed)
                text = first + np.searchsorted(bounds, at, "right") - 1
                rare.append((words.bucket(tokens[at]) * 2 + held[text], text, tokens[at], contexts[at]))
            n = batch.num_rows
            columns = {
                "bucket": pa.array(np.full(n, -1 - task)), "base": batch.column("row"),
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
            }
            for name, values in zip(("n_tokens", "n_known", "logs", "gain"), zip(*per_text)):
                columns[name] = pa.array(np.concatenate(values))
            yield _record(schema, n, columns)
            keys, text, tokens, contexts = (np.concatenate(x) for x in zip(*rare))
            order = np.argsort(keys, kind="stable")
            keys, text, tokens, contexts = keys[order], text[order], tokens[order], contexts[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            # Steps from one text to the next, which are small, in place of the texts.
            steps = np.diff(text, prepend=0)
            steps[at] = text[at]
            slices = list(zip(at, np.append(at[1:], len(keys))))
            yield _record(schema, len(at), {
                "bucket": pa.array(keys[at] // 2), "held_out": pa.array(keys[at] % 2 == 1),
                "base": pa.array(np.full(len(at), batch.column("row")[0].as_py())),
                "words": pa.array([tokens[a:b].astype("<u8").tobytes() for a, b in slices], pa.binary()),
                "contexts": pa.array([contexts[a:b].astype("<u4").tobytes() for a, b in slices], pa.binary()),
                "steps": pa.array([steps[a:b].astype("<i4").tobytes() for a, b in slices], pa.binary()),
            })

    return score


def _record(schema: pa.Schema, n: int, columns: dict) -> pa.RecordBatch:
    arrays = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def score_bucket(learn, words, contexts) -> tuple[np.ndarray, np.ndarray]:
    """The count among ``learn`` of each of a bucket's words, and its log probability in the
    bucket by a tree trained on those in ``learn``, in order."""
    names, n = np.unique(words[learn], return_counts=True)
    order = np.argsort(-n, kind="stable")
    forest = Forest(np.append(n[order], 0) + SMOOTHING, np.array([0, len(n) + 1]))
    leaf = np.empty(len(n) + 1, np.int64)
    leaf[order], leaf[-1] = np.arange(len(n)), len(n)
    at = np.searchsorted(names, words)
    seen = np.append(names, 0)[at] == words
    seen &= at < len(names)
    at = np.where(seen, at, len(names))
    leaves, counts = leaf[at], np.append(n, 0)[at]
    # Eight weights for each token learnt from.
    weights = np.zeros(1 << max(10, min(30, (8 * int(learn.sum())).bit_length())), np.complex64)
    own = np.flatnonzero(learn)
    for i in range(0, len(own), STEP):
        part = own[i:i + STEP]
        forest.update(weights, contexts[part], leaves[part])
    weights = weights.real.copy()
    gain = [forest.logs(weights, contexts[i:i + STEP], leaves[i:i + STEP]) for i in range(0, len(words), STEP)]
    return counts, np.concatenate(gain)


def _score_group(group: pa.Table) -> pa.Table:
    """Rows of documents as they are; of a bucket's tokens, their part of each document."""
    if group.column("bucket")[0].as_py() < 0:
        return group.drop_columns(["bucket", "words", "contexts", "steps"])
    group = group.sort_by([("base", "ascending"), ("held_out", "ascending")])

    def joined(name, kind):
        return np.frombuffer(b"".join(x.as_py() for x in group.column(name)), kind)

    words, steps = joined("words", "<u8"), joined("steps", "<i4")
    contexts = joined("contexts", "<u4").reshape(-1, TREE_FEATURES)
    sizes = np.array([len(x.as_py()) // 8 for x in group.column("words")])
    # Each list of steps begins at its batch's first row.
    sums = np.cumsum(steps, dtype=np.int64)
    before = np.concatenate(([0], sums))[np.cumsum(sizes) - sizes]
    rows = sums + np.repeat(group.column("base").to_numpy() - before, sizes)
    learn = np.repeat(~group.column("held_out").to_numpy(), sizes)
    counts, gain = score_bucket(learn, words, contexts)
    found, at = np.unique(rows, return_inverse=True)
    columns = {
        "base": pa.array(found),
        "n_known": pa.array(np.bincount(at, counts > 0).astype(np.int64)),
        "logs": pa.array(np.bincount(at, np.log10(counts + SMOOTHING))),
        "gain": pa.array(np.bincount(at, gain) / math.log(10)),
    }
    schema = pa.schema([f for f in group.schema if f.name not in ("bucket", "words", "contexts", "steps")])
    return pa.Table.from_batches([_record(schema, len(found), columns)])


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per document: the smoothed unigram score and the model's, as log10 probabilities.

    A null or empty text is one end token; a null key falls in the fold of the empty text;
    repeated rows are counted and scored each; an empty table gives an empty result; with
    no training documents all tokens are unknown. Columns other than key and text are
    ignored.
    """
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", text_or_empty().alias("text"), held_out("doc_id").alias("held_out"))
    train = named.filter(~F.col("held_out"))
    vocabulary = Vocabulary(token_counts(train))
    shared = spark.sparkContext.broadcast(train_classes(train, vocabulary, rounds))
    result = f"base long, doc_id {key}, held_out boolean, n_tokens long, n_known long, logs double, gain double"
    fields = f"bucket long, words binary, contexts binary, steps binary, {result}"
    parts = named.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _score_batches(shared, spark.sparkContext.broadcast(vocabulary), StructType.fromDDL(fields)), fields
    )
    scored = parts.groupBy("bucket").applyInArrow(_score_group, result).groupBy("base").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("held_out").alias("held_out"),
        *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "gain")),
    )
    total = vocabulary.tokens + SMOOTHING * (vocabulary.distinct + 1)
    return stage(scored.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(math.log10(total))).alias("base_score"),
        F.col("gain").alias("score"),
    ), "scored")


def op6_hashed_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
