"""Alignment of two tokenizers' tokens, with corpus-wide counts of the pairs they link.

Both tokenizers end a token at each space or newline that follows another character, so a
text falls into units that are aligned alone: a task encodes and aligns each distinct unit
once. The first pass writes, per task, the distinct pairs with their numbers of links. A
minimal perfect hash of the distinct pairs, in shards of bounded size, turns those numbers
into dense vectors, which are summed as a tree. The second pass aligns the documents again
and looks every pair up by its slot, where the pair itself is kept and compared.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import text as T
from demandlake.llm.perfect_hash import PerfectHash
from demandlake.llm.tables import stage, table
from demandlake.llm.tokens import byte_letters, tokenizer_path

BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Pairs of a shard on average, and shards whose vectors a task holds at once: 4,194,304
# pairs, some 72 MB. More pairs take more rounds.
SHARD_PAIRS, ROUND_SHARDS = 1 << 18, 16
# A task writes its pairs out when it holds so many.
HELD_PAIRS = 1 << 20
# Vectors added by one task of a level of the tree.
FAN_IN = 16
# Texts are cut into units for about so many bytes at a time.
RUN_BYTES = 4 << 20
# Beyond so many units a worker keeps those only that it has met in several runs.
KEPT_UNITS = 200_000
# New units are encoded together in texts of about so many bytes.
STRING_BYTES = 1 << 11
# UTF-8 of code points below U+0300 has only lesser bytes: what is a letter there, all agree.
_PLAIN_BYTES = 0xCC
_SPACE_PIECE = "▁"


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (T.mix(keys.astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(shards)).astype(np.int64)


def _quick_encoder(path: str, own: dict[str, int]):
    """An encoder with the merges of a byte-level tokenizer file that gives ids alone; none
    where the ids are not in the order of the merges, by which it goes."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(m)) for m in merges]
    letters = sorted(model["vocab"][c] for c in own)
    if made != list(range(256, 256 + len(made))) or letters != list(range(256)) or model.get("ignore_merges"):
        return None
    ranks = {
        bytes(own[c] for c in entry): i for entry, i in model["vocab"].items() if i < 256 + len(made)
    }
    return tiktoken.Encoding(
        "units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


class Aligner:
    """Both tokenizers, and the units they have aligned, a number each."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_path)
        self._a.encode_special_tokens = True
        own = {letter: byte for byte, letter in byte_letters().items()}
        entries = [self._a.id_to_token(i) or "" for i in range(self._a.get_vocab_size())]
        self._quick = _quick_encoder(byte_path, own)
        self._a_bytes = [bytes(own[c] for c in e) if all(c in own for c in e) else e.encode() for e in entries]
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self._b_bytes = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(_SPACE_PIECE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self._a_lengths, self._b_lengths = (
            np.array([len(e) for e in entries], np.int64) for entries in (self._a_bytes, self._b_bytes)
        )
        # The text of each token within a group and at the end of its side.
        self._signs = [
            b"%d%s" % (i, sign)
            for entries, ends in ((self._a_bytes, (b",", b"|")), (self._b_bytes, (b",", b";")))
            for i in range(len(entries)) for sign in ends
        ]
        self._space = self._b.piece_to_id(_SPACE_PIECE)
        #: Whether no token goes on past the beginning of a unit.
        self.cuts = (
            self._a.normalizer is None and str(self._a.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False")
            and self._space != self._b.unk_id()
            and not any("\n" in p or re.search(f"[^{_SPACE_PIECE}]{_SPACE_PIECE}", p) for p in pieces)
        )
        self._known: dict[bytes, int] = {}
        #: Raised when units are numbered anew.
        self.generation = 0
        self._runs = array("q")
        self.fine, self.n_a, self.n_b, self.n_groups = bytearray(), array("q"), array("q"), array("q")
        self.links, self.ends = array("q"), array("q")
        #: The groups as text, each with a semicolon after it.
        self.groups: list[bytes] = []

    def trim(self) -> None:
        """Forget the units that were met in one run only, and at most half of the room is
        left to the others, those met most."""
        runs = np.array(self._runs, np.int64)
        often = np.flatnonzero(runs > 1)
        kept = np.sort(often[np.argsort(-runs[often], kind="stable")][:KEPT_UNITS // 2])
        links, n_links = self.links_of(kept)
        self.fine = bytearray(np.frombuffer(bytes(self.fine), np.uint8)[kept].tobytes())
        for name in ("n_a", "n_b", "n_groups"):
            setattr(self, name, array("q", np.array(getattr(self, name), np.int64)[kept].tobytes()))
        self.links, self.ends = array("q", links.tobytes()), array("q", np.cumsum(n_links).tobytes())
        self._runs = array("q", np.ones(len(kept), np.int64).tobytes())
        self.groups = [self.groups[i] for i in kept.tolist()]
        number = np.full(len(runs), -1)
        number[kept] = np.arange(len(kept))
        number = number.tolist()
        self._known = {unit: number[i] for unit, i in self._known.items() if number[i] >= 0}
        self.generation += 1

    def __len__(self) -> int:
        return len(self.groups)

    def __call__(self, units: list[bytes]) -> np.ndarray:
        """The numbers of ``units``, which are distinct."""
        known = self._known
        new = [u for u in units if u not in known]
        if new:
            self._align(new)
            self._runs.frombytes(bytes(8 * len(new)))
        found = np.array([known[u] for u in units], np.int64)
        runs = np.array(self._runs, np.int64)
        runs[found] += 1
        self._runs = array("q", runs.tobytes())
        return found

    def _byte_ids(self, texts: list[str], plain: list[bool]) -> list[list[int]]:
        """Ids of texts; those of plain letters go to the same merges without offsets."""
        quick = self._quick
        if quick is None:
            plain = [False] * len(texts)
        others = [t for t, p in zip(texts, plain) if not p]
        coded = iter(self._a.encode_batch(others, add_special_tokens=False) if others else ())
        return [quick.encode_ordinary(t) if p else next(coded).ids for t, p in zip(texts, plain)]

    def _piece_ids(self, texts: list[str]) -> list[list[int]]:
        """The model puts a space before what it is given: that of the text is left out, or
        taken away again if the text begins with a newline."""
        found = self._b.encode([t.removeprefix(" ") for t in texts], num_threads=1)
        for i, t in enumerate(texts):
            if t == " ":
                found[i] = [self._space]
            elif not t.startswith(" "):
                found[i] = found[i][1:]
        return found

    def _strings(self, units: list[bytes]) -> Iterator[tuple[list[int], bool]]:
        """Units, by place, that are encoded as one text, and whether it is plain. A unit
        that ends in white space would run on into the next one."""
        if not self.cuts:
            yield from (([i], False) for i in range(len(units)))
            return
        held: dict[bool, list[int]] = {True: [], False: []}
        sizes = dict.fromkeys(held, 0)
        for i, unit in enumerate(units):
            plain = unit.isascii() or max(unit) < _PLAIN_BYTES
            if unit[-1] < 33 or unit[-1] > 127 and unit.decode()[-1].isspace():
                yield [i], plain
                continue
            held[plain].append(i)
            sizes[plain] += len(unit)
            if sizes[plain] >= STRING_BYTES:
                yield held[plain], plain
                held[plain], sizes[plain] = [], 0
        yield from ((places, plain) for plain, places in held.items() if places)

    def _align(self, units: list[bytes]) -> None:
        todo = list(self._strings(units))
        order: list[int] = []  # places of the units that both sides give back
        a_ids: list[int] = []
        b_ids: list[int] = []
        while todo:
            raw = [b"".join([units[i] for i in places]) for places, _ in todo]
            texts = [r.decode() for r in raw]
            again = []
            coded = zip(todo, raw, self._byte_ids(texts, [p for _, p in todo]), self._piece_ids(texts))
            for (places, plain), whole, a, b in coded:
                if (
                    b"".join([self._a_bytes[i] for i in a]) == whole == b"".join([self._b_bytes[i] for i in b])
                ):
                    order += places
                    a_ids += a
                    b_ids += b
                elif len(places) > 1:
                    again += [([i], plain) for i in places]
            todo = again
        sizes = np.array([len(units[i]) for i in order], np.int64)
        n_a, n_b, n_groups, n_links, groups, links = self._linked(np.array(a_ids, np.int64), np.array(b_ids, np.int64), sizes)

        known = len(self)
        # Units are numbered in the order they were encoded in, the others after them.
        fine = np.zeros(len(units), bool)
        fine[order] = True
        rest = np.flatnonzero(~fine).tolist()
        self.fine += bytes([1]) * len(order) + bytes(len(rest))
        for number, i in enumerate(chain(order, rest), start=known):
            self._known[units[i]] = number
        none = np.zeros(len(rest), np.int64)
        for store, values in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups)):
            store.frombytes(np.concatenate([values, none]).tobytes())
        self.ends.frombytes((len(self.links) + np.cumsum(np.concatenate([n_links, none]))).tobytes())
        self.links.frombytes(links.tobytes())
        self.groups += groups + [b""] * len(rest)

    def _linked(self, a_ids: np.ndarray, b_ids: np.ndarray, sizes: np.ndarray):
        """Counts, group texts and links of units of the given sizes, laid end to end.

        The ends of all tokens cut the bytes into pieces, and each piece is the overlap of
        just one token of either side: a link.
        """
        a_ends, b_ends = np.cumsum(self._a_lengths[a_ids]), np.cumsum(self._b_lengths[b_ids])
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        new = np.concatenate((ends[:-1] != ends[1:], [True])) if len(ends) else np.zeros(0, bool)
        pieces, both = ends[new], ends[1:][ends[:-1] == ends[1:]]
        a_at, b_at = np.searchsorted(a_ends, pieces), np.searchsorted(b_ends, pieces)
        unit_ends = np.cumsum(sizes)
        if (both[np.minimum(np.searchsorted(both, unit_ends), len(both) - 1)] != unit_ends).any():
            raise ValueError("a token goes beyond its unit")
        n_a, n_b, n_links, n_groups = (
            np.diff(np.searchsorted(e, unit_ends, "right"), prepend=0) for e in (a_ends, b_ends, pieces, both)
        )
        # A group's text has its tokens of the one side, then those of the other; the last
        # of each side has a sign of its own after it.
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        codes = np.concatenate([
            2 * a_ids + (both[a_group] == a_ends), 2 * (len(self._a_lengths) + b_ids) + (both[b_group] == b_ends)
        ])
        group = np.concatenate([2 * a_group, 2 * b_group + 1])
        codes = codes[np.argsort(group, kind="stable")].tolist()
        bounds = np.cumsum(n_a + n_b).tolist()
        signs = self._signs
        groups = [b"".join([signs[c] for c in codes[first:end]]) for first, end in zip([0, *bounds], bounds)]
        return n_a, n_b, n_groups, n_links, groups, a_ids[a_at] << 32 | b_ids[b_at]

    def links_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of units laid end to end, and how many each has."""
        links, ends = np.array(self.links, np.int64), np.array(self.ends, np.int64)
        begins = np.concatenate(([0], ends[:-1]))[numbers]
        size = ends[numbers] - begins
        before = np.cumsum(size) - size
        return links[np.repeat(begins - before, size) + np.arange(size.sum())], size


@lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def unit_starts(data: np.ndarray, offsets: np.ndarray, cuts: bool) -> np.ndarray:
    """Where units begin: at each text, and at each space or newline after a character that
    is not white space by Unicode."""
    if not cuts:
        return offsets[:-1]
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[at >= 3] if len(at) else at
    one, two, three = data[at - 1], data[at - 2], data[at - 3]
    apart = (one > 32) & ~(
        ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        | ((three == 0xE1) & (two == 0x9A) & (one == 0x80))
        | ((three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)))
        | ((three == 0xE2) & (two == 0x81) & (one == 0x9F))
        | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    )
    starts = np.sort(np.concatenate([offsets[:-1], at[apart]]), kind="stable")
    return starts[np.concatenate(([True], starts[1:] != starts[:-1]))] if len(starts) else starts


class Run:
    """The units of a run of texts, aligned."""

    def __init__(self, texts: pa.Array, aligner: Aligner):
        live = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(texts, ""), pa.scalar("", pa.large_string()))
        data, offsets = T.utf8(spaced)
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        starts = unit_starts(data, offsets, aligner.cuts)
        units = pa.Array.from_buffers(
            pa.large_binary(), len(starts),
            [None, pa.py_buffer(np.append(starts, offsets[-1]).astype(np.int64)), pa.py_buffer(data)],
        ).dictionary_encode()
        if len(aligner) > KEPT_UNITS:
            aligner.trim()
        numbers = aligner(units.dictionary.to_pylist())
        self.unit = numbers[units.indices.to_numpy(zero_copy_only=False)]
        self.first = np.searchsorted(starts, offsets)
        fine = np.frombuffer(bytes(aligner.fine), np.uint8)[self.unit]
        #: Whether each text has tokens at all.
        self.live = live & (T.per_text(fine == 0, self.first) == 0)

    def live_units(self) -> np.ndarray:
        return self.unit[np.repeat(self.live, np.diff(self.first))]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value of its units; 0 for a text without tokens."""
        ends = np.concatenate(([0], np.cumsum(values[self.unit], dtype=np.int64)))
        return np.where(self.live, ends[self.first[1:]] - ends[self.first[:-1]], 0)


def _runs(texts: pa.Array, aligner: Aligner) -> Iterator[tuple[int, Run]]:
    texts = texts.cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    sizes = np.concatenate(([0], np.cumsum(sizes)))
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(sizes, sizes[first] + RUN_BYTES, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, Run(texts.slice(first, end - first), aligner)
        first = end


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _pair_batches(paths: tuple[str, str]):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*paths)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, run in _runs(batch.column("text"), aligner):
                number, times = np.unique(run.live_units(), return_counts=True)
                links, size = aligner.links_of(number)
                keys, counts = _summed(
                    np.concatenate([keys, links]), np.concatenate([counts, np.repeat(times, size)])
                )
                if len(keys) >= HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "links"])
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "links"])

    return pairs


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``(pair, links)``: each task's distinct pairs, and in how many links it met them."""
    return docs.select("text").mapInArrow(_pair_batches((byte_path, piece_path)), "pair long, links long")


def _shard_batches(shards: int):
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("pair").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard_of(keys, shards)), batch.column("pair")], names=["shard", "pair"]
            )

    return dealt


def _hash_shard(pairs: pd.DataFrame) -> pd.DataFrame:
    keys = pairs["pair"].to_numpy()
    hashed = PerfectHash.of(keys)
    held = np.empty(len(keys), np.int64)
    held[hashed(keys)] = keys
    return pd.DataFrame({"shard": pairs["shard"].iloc[:1], "hash": [hashed.to_bytes()], "pairs": [held.tobytes()]})


class Shards:
    """The hashes of some shards, and a value per slot where there are values."""

    def __init__(self, rows: list, shards: int):
        self._shards = shards
        self._parts = {
            r["shard"]: (PerfectHash.from_bytes(bytes(r["hash"])), np.frombuffer(r["pairs"], np.int64)) for r in rows
        }

    def slots(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(shard, places, slots)`` of the keys in each shard that is held."""
        shard = shard_of(keys, self._shards)
        order = np.argsort(shard, kind="stable")
        for number in sorted(self._parts):
            first, end = np.searchsorted(shard[order], [number, number + 1])
            if first < end:
                places = order[first:end]
                hashed, held = self._parts[number]
                slots = hashed(keys[places])
                if (slots < 0).any() or (held[slots] != keys[places]).any():
                    raise ValueError("a pair is missing from the table of pairs")
                yield number, places, slots

    def width(self, shard: int) -> int:
        return len(self._parts[shard][1])


def _dense_batches(shards: Broadcast, count: int):
    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vectors = Shards(shards.value, count), {}
        for batch in batches:
            keys, links = batch.column("pair").to_numpy(), batch.column("links").to_numpy()
            for shard, places, slots in held.slots(keys):
                if shard not in vectors:
                    vectors[shard] = np.zeros(held.width(shard), np.int64)
                np.add.at(vectors[shard], slots, links[places])
        branch = TaskContext.get().partitionId()
        for shard, vector in vectors.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([branch]), pa.array([vector.tobytes()], pa.binary())],
                names=["shard", "branch", "counts"],
            )

    return dense


def _add_vectors(vectors: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(v, np.int64) for v in vectors["counts"]], axis=0)
    first = vectors.iloc[:1]
    return pd.DataFrame({"shard": first["shard"], "branch": first["branch"], "counts": [total.tobytes()]})


def tree_sum(vectors: DataFrame) -> DataFrame:
    """One vector per shard: those of ``FAN_IN`` branches are added at each level."""
    vectors = stage(vectors, "dense-counts")
    branches = (vectors.agg(F.max("branch").alias("last")).first()["last"] or 0) + 1
    while True:
        branches = -(-branches // FAN_IN)
        vectors = vectors.withColumn("branch", F.floor(F.col("branch") / FAN_IN)).groupBy("shard", "branch")
        vectors = stage(vectors.applyInPandas(_add_vectors, "shard long, branch long, counts binary"), "tree-sums")
        if branches == 1:
            return vectors.drop("branch")


def _highest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The highest count of each second id of a shard."""
    for batch in batches:
        for pairs, counts in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist()):
            b = np.frombuffer(pairs, np.int64) & 0xFFFFFFFF
            counts = np.frombuffer(counts, np.int64)
            highest = np.zeros(int(b.max()) + 1, np.int64)
            np.maximum.at(highest, b, counts)
            ids = np.flatnonzero(highest)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(highest[ids])], names=["b", "highest"])


_RESULT = (
    "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _lookup_batches(paths: tuple[str, str], count: int, rows: Broadcast, highest: Broadcast):
    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*paths)
        held = Shards(rows.value, count)
        counts = {r["shard"]: np.frombuffer(r["counts"], np.int64) for r in rows.value}
        best, total, generation = np.zeros(0, np.int64), np.zeros(0, np.int64), aligner.generation
        for batch in batches:
            for first, run in _runs(batch.column("text"), aligner):
                if generation != aligner.generation:
                    best, total, generation = best[:0], total[:0], aligner.generation
                done, size = len(best), len(aligner)
                live = np.unique(run.live_units())
                best = np.append(best, np.full(size - done, -1))
                total = np.append(total, np.zeros(size - done, np.int64))
                new = live[best[live] < 0]
                links, n = aligner.links_of(new)
                worth, top = np.zeros(len(links), np.int64), np.zeros(len(links), bool)
                for shard, places, slots in held.slots(links):
                    worth[places] = counts[shard][slots]
                    top[places] = worth[places] == highest.value[links[places] & 0xFFFFFFFF]
                ends = np.concatenate(([0], np.cumsum(n)))
                best[new] = T.per_text(top, ends)
                sums = np.concatenate(([0], np.cumsum(worth)))
                total[new] = sums[ends[1:]] - sums[ends[:-1]]

                n_a, n_b = run.sums(np.array(aligner.n_a)), run.sums(np.array(aligner.n_b))
                n_groups = run.sums(np.array(aligner.n_groups))
                numbers = run.unit.tolist()
                shas = [
                    hashlib.sha256(b"".join([aligner.groups[u] for u in numbers[a:b]])[:-1]).hexdigest()
                    if live_text else ""
                    for live_text, a, b in zip(run.live.tolist(), run.first[:-1].tolist(), run.first[1:].tolist())
                ]
                rest = [batch.column(c).slice(first, len(shas)) for c in batch.schema.names if c != "text"]
                columns = [n_a, n_b, n_groups, n_a + n_b - n_groups, run.sums(best), run.sums(total)]
                yield pa.RecordBatch.from_arrays(
                    [*rest, *map(pa.array, columns), pa.array(shas, pa.string())],
                    names=[*(c for c in batch.schema.names if c != "text"), *(c.split()[0] for c in _RESULT.split(", "))],
                )

    return looked_up


def align_tokenizers(
    docs: DataFrame, byte_tokenizer: str = BYTE_TOKENIZER, piece_tokenizer: str = PIECE_TOKENIZER,
    shard_pairs: int = SHARD_PAIRS, round_shards: int = ROUND_SHARDS,
) -> DataFrame:
    """Per document: tokens of both tokenizers, groups that end together, links, links whose
    pair has the highest count of its second id, the sum of the counts, and the groups' hash.

    A null or empty text, and one that a tokenizer does not give back byte for byte, has no
    tokens, zeros and an empty hash; a null key stays null; repeated rows count each; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    paths = tokenizer_path(byte_tokenizer), tokenizer_path(piece_tokenizer)
    met = stage(pair_counts(docs, *paths), "pairs-of-tasks")
    distinct = stage(met.select("pair").distinct(), "distinct-pairs")
    shards = max(1, -(-distinct.count() // shard_pairs))
    hashes = stage(
        distinct.mapInArrow(_shard_batches(shards), "shard long, pair long")
        .groupBy("shard").applyInPandas(_hash_shard, "shard long, hash binary, pairs binary"),
        "pair-hashes",
    )
    rounds, summed = range(0, shards, round_shards), []
    for first in rounds:
        mine = F.col("shard").between(first, first + round_shards - 1)
        held = spark.sparkContext.broadcast(hashes.filter(mine).collect())
        summed.append(tree_sum(
            met.mapInArrow(_dense_batches(held, shards), "shard long, branch long, counts binary")
        ))
        held.unpersist()
    counted = [hashes.join(counts, "shard") for counts in summed]

    tops = counted[0]
    for more in counted[1:]:
        tops = tops.union(more)
    tops = tops.select("pairs", "counts").mapInArrow(_highest_batches, "b long, highest long")
    # One row per id of the second tokenizer.
    tops = tops.groupBy("b").agg(F.max("highest").alias("highest")).collect()
    highest = np.zeros(max([r["b"] for r in tops], default=0) + 1, np.int64)
    for r in tops:
        highest[r["b"]] = r["highest"]
    highest = spark.sparkContext.broadcast(highest)

    def looked_up(columns: list[str], held: DataFrame) -> DataFrame:
        rows = spark.sparkContext.broadcast(held.collect())
        kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns]
        return docs.select(*columns, "text").mapInArrow(
            _lookup_batches(paths, shards, rows, highest), ", ".join([*kinds, _RESULT])
        )

    found = looked_up(["doc_id"], counted[0])
    if len(counted) == 1:
        return found
    # Each further round adds what its pairs are worth; equal groups are worth the same.
    worth = None
    for held in counted:
        part = stage(looked_up([], held).select("groups_sha256", "n_best", "count_sum").distinct(), "worth")
        worth = part if worth is None else worth.union(part)
    worth = stage(worth.groupBy("groups_sha256").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    ), "worth")
    return found.drop("n_best", "count_sum").join(worth, "groups_sha256").select(
        "doc_id", *(c.split()[0] for c in _RESULT.split(", "))
    )


def op13_perfect_hash_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))
