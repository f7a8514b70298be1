"""Boosted regression trees that stop by patience.

Each round fits a tree to what is left of the label, adds a share of it to the fitted values,
and is measured on the validation rows. Boosting ends once the best round lies ``patience``
rounds back, and the model is rolled back to that round.

Features are binned once, and the bins of a few features make one code, so that one count gives
the sums of all of them. A row is a few codes, its label and its fitted value. A level of a tree
is one pass over the rows: tasks count them, and sum what is left of the label, per node, feature
and bin; the best splits follow from these sums, whose size does not depend on the rows. Of two
children only the smaller is counted, the other is what is left of their parent. What is left of
the label is rounded to whole numbers of a small unit, so the sums are exact in any order.

All rounds are one stage whose tasks run side by side, keep their rows and hand each other the
sums of a pass (``blocks.together``): a job for each pass costs more than the pass. Where the
cluster cannot do that, a pass is a job over kept blocks, which are written every few rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.operators.blocks import Sums, in_file, numpy_blocks, packed, side_by_side, summed, together
from demandlake.session import scratch_root, stage

# Rounds between two writes of the blocks, and bins of a number's candidate splits.
BLOCK, BINS = 50, 64
# Training rows that candidate splits are taken from, as Spark ML does with 10,000; every row
# counts where the splits are chosen.
SPLIT_ROWS = 100_000
# Bins of the features that share a code, multiplied, and rows that are counted at a time. So many
# sums of whole numbers below 2**32 are exact as doubles.
CODES, CHUNK = 4096, 1 << 18
# Training rows that a task more is worth, and bytes of rows that a task holds in memory.
TASK_ROWS, HELD = 16_384, 96 << 20
# A unit of what is left of the label, and of its square, as shares of the greatest label.
_UNIT_BITS, _SQUARE_BITS = 30, 40


@dataclass(frozen=True)
class Tree:
    """Nodes in the order of a walk; a leaf has no feature (-1) and leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    @classmethod
    def of(cls, rows: Sequence[tuple[int, float, int, int, float]], depth: int) -> Tree:
        feature, threshold, left, right, value = map(np.array, zip(*rows))
        return cls(feature, threshold, left, right, value, depth)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = np.zeros(len(values), np.int64)
        row = np.arange(len(values))
        for _ in range(self.depth):
            below = values[row, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(below, self.left[at], self.right[at])
        return self.value[at]


@dataclass(frozen=True)
class BoostedTrees:
    features: tuple[str, ...]
    start: float
    rate: float
    trees: tuple[Tree, ...]
    #: The validation error after each round, the dropped ones too.
    curve: tuple[float, ...] = ()

    def __call__(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.start)
        codes = self._codes.of([values[:, f] for f in range(len(self.features))])
        for tree, masks in zip(self.trees, self._masks):
            if masks is None:
                total += self.rate * tree(values)
                continue
            left = None
            for g, parts in masks[0]:
                found = reduce(lambda a, b: (a[:, None] & b).ravel(), parts).take(codes[g])
                left = found if left is None else left & found
            total += masks[1].take((left * _DE_BRUIJN) >> _TOP)
        return total

    @cached_property
    def _codes(self) -> _Codes:
        """Of bins between the thresholds that the trees have."""
        at = [(f, t) for tree in self.trees for f, t in zip(tree.feature, tree.threshold) if f >= 0]
        return _Codes([np.unique([t for f, t in at if f == i]).astype(float) for i in range(len(self.features))])

    @cached_property
    def _masks(self) -> list[tuple[list, np.ndarray] | None]:
        """Of each tree, by group and feature, the leaves that each bin leaves open, a bit each,
        and the steps of the leaves by the place of a bit; None for a tree of over 32 leaves."""
        return [_leaf_masks(tree, self._codes, self.rate) for tree in self.trees]

    def predict(self) -> Column:
        """The model as a column over its feature columns."""

        @F.pandas_udf("double")
        def boosted(*columns: pd.Series) -> pd.Series:
            return pd.Series(self(np.column_stack([c.to_numpy(float) for c in columns])))

        return boosted(*[F.col(c).cast("double") for c in self.features])

    def save(self, spark: SparkSession, path: str) -> None:
        nodes = [
            (i, n, int(t.feature[n]), float(t.threshold[n]), int(t.left[n]), int(t.right[n]), float(t.value[n]), t.depth)
            for i, t in enumerate(self.trees) for n in range(len(t.value))
        ]
        spark.createDataFrame(
            nodes, "tree int, node int, feature int, threshold double, left int, right int, value double, depth int"
        ).coalesce(1).write.parquet(f"{path}/nodes")
        spark.createDataFrame(
            [(list(self.features), self.start, self.rate, list(self.curve))],
            "features array<string>, start double, rate double, curve array<double>",
        ).coalesce(1).write.parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        head = spark.read.parquet(f"{path}/model").first()
        rows: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            rows.setdefault(r["tree"], []).append(r)
        trees = tuple(
            Tree.of([(r["feature"], r["threshold"], r["left"], r["right"], r["value"]) for r in nodes], nodes[0]["depth"])
            for _, nodes in sorted(rows.items())
        )
        return cls(tuple(head["features"]), head["start"], head["rate"], trees, tuple(head["curve"]))


def best_round(curve: Sequence[float], patience: int) -> tuple[int, bool]:
    """How many rounds to keep, and whether ``patience`` rounds without a better one end it
    there. Of equal errors the first counts."""
    best = 0
    for i, error in enumerate(curve):
        if error < curve[best]:
            best = i
        if i - best >= patience:
            return best + 1, True
    return best + 1 if curve else 0, False


def candidate_splits(values: np.ndarray) -> np.ndarray:
    """Thresholds between neighbouring values, at most ``BINS - 1`` of them, that cut the
    values into shares as equal as can be; all of them where there are no more."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) < BINS:
        return middles
    stride = len(values) / BINS
    found, target, until = [], stride, np.cumsum(counts)
    for i in range(1, len(distinct)):
        if abs(until[i - 1] - target) < abs(until[i] - target):
            found.append(middles[i - 1])
            target += stride
    return np.array(found)


class _Codes:
    """Features in groups whose bins are told by one number below ``CODES``.

    The code of a group counts through the bins of its features, the last one fastest; a feature
    with more bins than that has a group of its own.
    """

    def __init__(self, cuts: Sequence[np.ndarray]) -> None:
        self.cuts = cuts
        self.bins = [len(c) + 1 for c in cuts]
        self.groups: list[list[int]] = []
        for f in sorted(range(len(cuts)), key=lambda f: -self.bins[f]):
            fits = [g for g in self.groups if self.size(g) * self.bins[f] <= CODES]
            if fits:
                fits[0].append(f)
            else:
                self.groups.append([f])

    def size(self, group: Sequence[int]) -> int:
        return math.prod(self.bins[f] for f in group)

    def of(self, values: Sequence[np.ndarray]) -> list[np.ndarray]:
        found = []
        for group in self.groups:
            code = np.zeros(len(values[group[0]]), np.int64)
            for f in group:
                code *= self.bins[f]
                code += np.searchsorted(self.cuts[f], values[f])
            found.append(code)
        return found

    @cached_property
    def bin_of(self) -> dict[int, np.ndarray]:
        """The bins of a feature by the code of its group."""
        return {
            f: np.arange(self.size(group)) // self.size(group[i + 1:]) % self.bins[f]
            for group in self.groups for i, f in enumerate(group)
        }

    def split_up(self, found: Sequence[np.ndarray], nodes: int) -> np.ndarray:
        """Sums by feature, node and bin from those by node and code, a table a group."""
        sums = np.zeros((len(self.bins), nodes, max(BINS, *self.bins)), np.int64)
        for group, held in zip(self.groups, found):
            for f in group:
                held = held.reshape(nodes, self.bins[f], -1)
                sums[f, :, :self.bins[f]] = held.sum(2)
                held = held.sum(1)
        return sums


# Multiplied by a single bit, leaves a number in the upper five bits that tells which one it was.
_DE_BRUIJN, _TOP, _LEAVES = np.uint32(0x077CB531), np.uint32(27), 32


def _leaf_masks(tree: Tree, codes: _Codes, rate: float) -> tuple[list, np.ndarray] | None:
    leaves = [i for i, f in enumerate(tree.feature) if f < 0]
    if len(leaves) > _LEAVES:
        return None
    bit = {node: 1 << i for i, node in enumerate(leaves)}

    def below(node: int) -> int:
        if node not in bit:
            bit[node] = below(int(tree.left[node])) | below(int(tree.right[node]))
        return bit[node]

    below(0)
    full = np.uint32((1 << _LEAVES) - 1)
    masks = [np.full(n, full) for n in codes.bins]
    for node, f in enumerate(tree.feature):
        if f >= 0:
            after = int(np.searchsorted(codes.cuts[f], tree.threshold[node])) + 1
            masks[f][:after] &= full ^ np.uint32(bit[int(tree.right[node])])
            masks[f][after:] &= full ^ np.uint32(bit[int(tree.left[node])])
    if len(leaves) < _LEAVES:
        unused = full ^ np.uint32((1 << len(leaves)) - 1)
        for mask in masks:
            mask &= ~unused
    steps = np.zeros(_LEAVES)
    for i, node in enumerate(leaves):
        steps[(1 << i) * int(_DE_BRUIJN) % 2**32 >> int(_TOP)] = rate * tree.value[node]
    used = set(map(int, tree.feature))
    open_ = [
        (g, [masks[f] for f in group])
        for g, group in enumerate(codes.groups) if not g or any(f in used for f in group)
    ]
    return open_, steps


@dataclass(frozen=True)
class _Level:
    """The splits of a level: ``(place, feature, cut)``, where a place is that of a node among
    those which no split has divided so far. ``first`` is the place of a node, or that of its
    left child, at the next level; the right child comes next."""

    splits: tuple[tuple[int, int, int], ...]
    first: np.ndarray
    codes: _Codes = field(repr=False)

    @cached_property
    def _right(self) -> list[tuple[int, np.ndarray]]:
        """By group, the nodes at which a code goes right: a bit a node, or a row where a number
        has no room for the bits."""
        nodes, found = len(self.first), []
        for g, group in enumerate(self.codes.groups):
            mine = [s for s in self.splits if s[1] in group]
            if not mine:
                continue
            if nodes <= 64:
                kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if nodes <= t(0).nbytes * 8)
                table = np.zeros(self.codes.size(group), kind)
            else:
                table = np.zeros((nodes, self.codes.size(group)), bool)
            for place, f, cut in mine:
                right = self.codes.bin_of[f] > cut
                if nodes <= 64:
                    table |= right.astype(table.dtype) << table.dtype.type(place)
                else:
                    table[place] = right
            found.append((g, table))
        return found

    def next(self, at: np.ndarray, codes: Sequence[np.ndarray]) -> np.ndarray:
        found = None
        for g, table in self._right:
            if table.ndim == 1:
                part = table.take(codes[g])
            else:
                part = table.ravel().take(at.astype(np.int64) * table.shape[1] + codes[g])
            found = part if found is None else found | part
        if len(self.first) <= 64:
            found = found >> at.astype(found.dtype) & found.dtype.type(1)
        # Where every node is divided, its left child has twice its place.
        all_divided = at.dtype == self.first.dtype and len(self.splits) == len(self.first)
        first = at * at.dtype.type(2) if all_divided else self.first.take(at)
        return first + found.astype(self.first.dtype)


@dataclass
class _Block:
    """Rows by the codes of their groups, those of training first, and what the rounds so far
    make of them."""

    codes: list[np.ndarray]
    label: np.ndarray
    fitted: np.ndarray
    train: int
    #: Of the tree that is growing: each row's place after so many levels, and what is left.
    at: np.ndarray | None = None
    levels: int = -1
    rest: np.ndarray | None = None
    in_files: bool = False

    def size(self) -> int:
        """Bytes of the rows: codes, label, fitted value, place and what is left."""
        return len(self.label) * (2 * len(self.codes) + self.label.itemsize + 8 + 1 + 4)

    def to_files(self) -> _Block:
        return _Block([*map(in_file, self.codes)], in_file(self.label), in_file(self.fitted), self.train, in_files=True)

    def _kept(self, new: np.ndarray, old: np.ndarray | None) -> np.ndarray:
        if not self.in_files:
            return new
        if old is None or old.dtype != new.dtype:
            return in_file(new)
        old[:] = new
        return old

    def places(self, levels: Sequence[_Level]) -> np.ndarray:
        if self.levels < 0:
            self.at, self.levels = self._kept(np.zeros(len(self.label), np.uint8), self.at), 0
        for level in levels[self.levels:]:
            self.at = self._kept(level.next(self.at, self.codes), self.at)
        self.levels = len(levels)
        return self.at

    def left(self, unit: float) -> np.ndarray:
        if self.levels < 0 or self.rest is None:
            rest = (self.label[:self.train] - self.fitted[:self.train]) / unit
            np.rint(rest, out=rest)
            if rest.size and max(rest.max(), -rest.min()) < 2**31:
                rest = rest.astype(np.int32)
            self.rest = self._kept(rest, self.rest)
            self.places(())
        return self.rest

    def advance(self, steps: np.ndarray, levels: Sequence[_Level]) -> None:
        self.fitted += steps.take(self.places(levels))
        self.levels = -1
        if not self.in_files:
            self.at = self.rest = None


def _pack(codes: _Codes, start: float) -> Callable[[pa.RecordBatch], _Block]:
    def pack(batch: pa.RecordBatch) -> _Block:
        *values, label, held_out = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held_out, label = held_out.astype(bool), label.astype(float)
        values = [v.astype(float) for v in values]
        if any(np.isnan(v).any() for v in values) or not np.isfinite(label[~held_out]).all():
            raise ValueError("features and training labels must be numbers, not null")
        order = np.argsort(held_out, kind="stable")
        narrow = [c[order].astype(np.uint16) for c in codes.of(values)]
        # Half the room where it holds the same numbers.
        with np.errstate(over="ignore"):
            half = label.astype(np.float32)
        label = half if np.array_equal(half, label, equal_nan=True) else label
        return _Block(narrow, label[order], np.full(len(label), start), int((~held_out).sum()))

    return pack


def _joined(blocks: Iterator[_Block]) -> Iterator[_Block]:
    """Blocks of about ``CHUNK`` rows, for small ones cost more than their rows."""

    def join(held: list[_Block]) -> _Block:
        def rows(of: Callable[[_Block], np.ndarray]) -> np.ndarray:
            return np.concatenate([of(b)[:b.train] for b in held] + [of(b)[b.train:] for b in held])

        codes = [rows(lambda b: b.codes[g]) for g in range(len(held[0].codes))]
        return _Block(codes, rows(lambda b: b.label), rows(lambda b: b.fitted), sum(b.train for b in held))

    held, n = [], 0
    for block in blocks:
        if held and n + len(block.label) > CHUNK:
            yield join(held)
            held, n = [], 0
        held.append(block)
        n += len(block.label)
    if held:
        yield join(held)


@dataclass
class _Growing:
    """A tree while it grows: ``places`` are the nodes that no split has divided so far."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    value: list[float]
    places: list[int]
    levels: list[_Level] = field(default_factory=list)

    def split(self, codes: _Codes, splits: dict[int, tuple[int, int]]) -> None:
        """Divide nodes whose children are there."""
        first, places = [], []
        for node in self.places:
            first.append(len(places))
            places += [self.left[node], self.right[node]] if node in splits else [node]
        at = tuple((self.places.index(n), *s) for n, s in splits.items())
        self.levels.append(_Level(at, np.array(first, np.uint8 if len(places) <= 256 else np.int32), codes))
        self.places = places


def _advanced(tree: _Growing, rate: float) -> Callable[[_Block], _Block]:
    """Adds a share of the tree to the fitted values."""
    step = rate * np.array([tree.value[n] for n in tree.places])

    def advance(block: _Block) -> _Block:
        block.advance(step, tree.levels)
        return block

    return advance


def _histograms(
    codes: _Codes, unit: float, levels: Sequence[_Level] = (), places: Sequence[int] = (0,)
) -> Callable[[_Block], Sums]:
    """Rows and what is left of their labels by feature, node and bin, of the nodes at some of
    the places."""
    slots = np.full(len(levels[-1].first) + len(levels[-1].splits) if levels else 1, len(places), np.int32)
    slots[list(places)] = np.arange(len(places))
    levels = tuple(levels)

    def count(block: _Block) -> Sums:
        rest, slot, wanted = block.left(unit), None, None
        if levels:
            slot = slots.take(block.places(levels)[:block.train])
            wanted = np.flatnonzero(slot < len(places))
            slot, rest = slot.take(wanted).astype(np.int64), rest.take(wanted)
        rows, left = [], []
        for group, code in zip(codes.groups, block.codes):
            size = codes.size(group)
            if slot is None:
                place = code[:block.train].astype(np.int64)
            else:
                place = slot * size
                place += code.take(wanted)
            rows.append(np.bincount(place, minlength=len(places) * size))
            # Whole numbers below 2**53 in a block, so exact as doubles.
            left.append(np.bincount(place, rest, len(places) * size))
        return Sums((codes.split_up(rows, len(places)), codes.split_up(left, len(places))))

    return count


def _errors(square: float) -> Callable[[_Block], Sums]:
    """Squared errors of validation rows, as whole numbers, and how many these are."""

    def measure(block: _Block) -> Sums:
        error = block.label[block.train:] - block.fitted[block.train:]
        error = error[~np.isnan(error)]
        whole = np.rint(error * error / square)
        high = np.floor(whole / 2**32)
        return Sums((int(high.sum()) * 2**32 + int((whole - high * 2**32).sum()), len(error)))

    return measure


def _best_split(rows: np.ndarray, left: np.ndarray, cuts: Sequence[np.ndarray], least_leaf: int):
    """``(feature, cut)`` of the greatest fall in variance, the first of equal ones; None where
    nothing falls. ``rows`` and ``left`` hold sums by feature and bin."""
    below, above = rows.cumsum(1), rows.sum(1, keepdims=True) - rows.cumsum(1)
    low, high = left.cumsum(1), left.sum(1, keepdims=True) - left.cumsum(1)
    apart = low / np.maximum(below, 1) - high / np.maximum(above, 1)
    gain = below.astype(float) * above * apart * apart
    place = np.arange(BINS) < np.array([len(c) for c in cuts])[:, None]
    gain[~place | (below < least_leaf) | (above < least_leaf)] = 0
    if not gain.max() > 0:
        return None
    feature, cut = divmod(int(gain.argmax()), BINS)
    return feature, cut, (int(below[feature, cut]), int(low[feature, cut])), (int(above[feature, cut]), int(high[feature, cut]))


def _grow(
    first: Sums, pass_over: Callable[[Callable], Sums], codes: _Codes, depth: int, least_leaf: int, unit: float
) -> _Growing | None:
    """The next tree, level by level, from the sums of its root; None where no split is left."""
    tree = _Growing([-1], [0], [0], [0], [0.0], [0])
    # Sums of the open nodes, by feature and bin.
    opened = {0: tuple(part[:, 0] for part in first)}
    for level in range(depth):
        splits, families = {}, []
        for node, sums in opened.items():
            found = _best_split(*sums, codes.cuts, least_leaf)
            if found is None:
                continue
            tree.feature[node], tree.cut[node] = splits[node] = found[:2]
            for side, (n, total) in zip((tree.left, tree.right), found[2:]):
                side[node] = child = len(tree.value)
                for values, value in ((tree.feature, -1), (tree.cut, 0), (tree.left, child), (tree.right, child)):
                    values.append(value)
                tree.value.append(total / n * unit)
            pair = tree.left[node], tree.right[node]
            families.append((node, *(pair if found[2][0] <= found[3][0] else pair[::-1])))
        if not families:
            break
        tree.split(codes, splits)
        if level + 1 < depth:
            places = [tree.places.index(small) for _, small, _ in families]
            counted = pass_over(_histograms(codes, unit, tree.levels, places))
            found = {}
            for slot, (node, small, large) in enumerate(families):
                found[small] = tuple(part[:, slot] for part in counted)
                found[large] = tuple(whole - part for whole, part in zip(opened[node], found[small]))
            opened = {node: found[node] for node in sorted(found)}
    return tree if tree.levels else None


class _Jobs:
    """A pass is a job over blocks that stay with the executors."""

    def __init__(self, rows: DataFrame, pack: Callable[[pa.RecordBatch], _Block]) -> None:
        context = rows.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(scratch_root(rows.sparkSession))
        self.state: RDD = numpy_blocks(rows, pack, _joined)
        self.before: RDD | None = None
        self.rounds = 0

    def summed(self, sums: Callable[[_Block], Sums]) -> Sums:
        found = summed(self.state, sums)
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        return found

    def advance(self, advanced: Callable[[_Block], _Block]) -> None:
        self.before, self.state = self.state, self.state.map(advanced).persist(StorageLevel.MEMORY_AND_DISK)
        self.rounds += 1
        if self.rounds % BLOCK == 0:
            self.state.checkpoint()


class _Held:
    """A pass goes over the blocks that this task holds, and adds the sums of all tasks. What
    memory has no room for is held in files."""

    def __init__(self, blocks: Iterator[_Block], exchange: Callable[[Sums | None], Sums]) -> None:
        self.blocks, self.exchange, size = [], exchange, 0
        for block in blocks:
            size += block.size()
            self.blocks.append(block if size <= HELD else block.to_files())

    def summed(self, sums: Callable[[_Block], Sums]) -> Sums:
        return self.exchange(reduce(add, map(sums, self.blocks)) if self.blocks else None)

    def advance(self, advanced: Callable[[_Block], _Block]) -> None:
        for block in self.blocks:
            advanced(block)


@dataclass(frozen=True)
class _Fit:
    codes: _Codes
    unit: float
    square: float
    measured: bool
    rounds: int
    rate: float
    depth: int
    patience: int
    least_leaf: int

    def boost(self, rows: _Jobs | _Held) -> tuple[tuple[Tree, ...], tuple[float, ...]]:
        """The trees that stay, and the validation error after each round."""
        root, measure = _histograms(self.codes, self.unit), _errors(self.square)
        sums = rows.summed(root)
        trees: list[Tree] = []
        curve: list[float] = []
        ended = False
        while not ended and len(trees) < self.rounds:
            grown = _grow(sums, rows.summed, self.codes, self.depth, self.least_leaf, self.unit)
            if grown is None:
                break
            threshold = [self.codes.cuts[f][c] if f >= 0 else 0.0 for f, c in zip(grown.feature, grown.cut)]
            value = [0.0 if f >= 0 else v for f, v in zip(grown.feature, grown.value)]
            trees.append(Tree.of([*zip(grown.feature, threshold, grown.left, grown.right, value)], self.depth))
            rows.advance(_advanced(grown, self.rate))
            # One pass advances the rows, measures the round and begins the next tree.
            *sums, error, n = rows.summed(lambda b: Sums((*root(b), *measure(b))))
            if self.measured:
                curve.append(error * self.square / n if n else math.nan)
                ended = best_round(curve, self.patience)[1]
        kept = best_round(curve, self.patience)[0] if self.measured else len(trees)
        return tuple(trees[:kept]), tuple(curve)


def fit_boosted(
    frame: DataFrame,
    features: Sequence[str],
    label: str,
    validation: str,
    rounds: int = 1000,
    rate: float = 0.05,
    depth: int = 5,
    patience: int = 30,
    least_leaf: int = 20,
    seed: int = 42,
) -> BoostedTrees:
    """Boost squared loss on the rows not marked by ``validation``.

    Without validation rows no error is known and all rounds stay; boosting also ends where
    no split is left. Features must not be null. ``seed`` draws the rows that candidate splits
    are taken from where there are more than ``SPLIT_ROWS``.
    """
    spark = frame.sparkSession
    rows = frame.select(
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
        F.col(label).cast("double").alias("y"), F.col(validation).alias("held_out"),
    )
    rows = stage(rows.where("held_out IS NOT NULL"), "boosting")
    train = rows.where("NOT held_out")
    facts = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("y")).alias("most")).first()
    measured = not rows.where("held_out").isEmpty()
    if facts["most"] is None:
        return BoostedTrees(tuple(features), 0.0, rate, ())
    if not math.isfinite(facts["most"]):
        raise ValueError("training labels must be finite")
    # Powers of two, so that scaling rounds nothing.
    scale = 2.0 ** math.ceil(math.log2(facts["most"] or 1.0))
    unit, square = scale / 2**_UNIT_BITS, scale * scale / 2**_SQUARE_BITS
    whole = F.round(F.col("y") / unit).cast("decimal(38,0)")
    total = train.agg(F.sum(whole).alias("total"), F.count("y").alias("n")).first()
    start = float(total["total"] / total["n"]) * unit
    drawn = train if facts["n"] <= SPLIT_ROWS else train.sample(SPLIT_ROWS / facts["n"], seed)
    drawn = drawn.select(*rows.columns[:-2]).toArrow()  # about SPLIT_ROWS rows at most
    codes = _Codes([candidate_splits(c.to_numpy()) for c in drawn.columns])
    fit = _Fit(codes, unit, square, measured, rounds, rate, depth, patience, least_leaf)
    pack = _pack(codes, start)
    tasks = side_by_side(spark, math.ceil(facts["n"] / TASK_ROWS))
    if tasks:
        trees, curve = together(packed(rows, pack), tasks, lambda blocks, exchange: fit.boost(_Held(_joined(blocks), exchange)))
    else:
        jobs = _Jobs(rows, pack)
        trees, curve = fit.boost(jobs)
        jobs.state.unpersist()
    return BoostedTrees(tuple(features), start, rate, trees, curve)
