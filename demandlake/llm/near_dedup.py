"""Near-duplicate documents by SetSketch registers, banding and exact confirmation.

A document's set is its distinct five-word shingles. Equal sets are one class from the
start, so exact copies cost nothing later. Each class keeps a sketch of exponentially
spaced, truncated minima: registers merge by maximum and agree about as often as sets
overlap. Equal bands of registers put classes into buckets; a bucket is not expanded into
pairs but compared with one pivot. Pairs whose likelihood estimate from the registers is far
below the threshold are dropped, the others are confirmed on their full sets. Classes that
are still apart from most of their group are then compared with all of it, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import text as T
from demandlake.llm.tables import only_keys, stage, table

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
# Below the threshold by six deviations of the estimate: 0.75 - 6 * sqrt(0.75 * 0.25 / 240).
LEAST_ESTIMATE = 0.58
# Registers agree about as often as sets overlap: at the threshold, fewer than half of them do
# with a chance below 1e-15 (nine deviations).
LEAST_EQUAL = int(0.5 * REGISTERS)
# Classes of a bucket or group that meet as many others in one task.
BLOCK = 2000

_rng = np.random.default_rng(7)
_FACTOR = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_BAND_SEED = T.mix(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(20))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = T.words(data, offsets, lower=True)
    _, hashes = words.windows(SHINGLE)
    n_words = np.diff(words.first)
    ends = np.cumsum(np.maximum(n_words - SHINGLE + 1, 0))
    whole = T.RangeHash(words.hashes)
    for i, n in enumerate(n_words.tolist()):
        if n >= SHINGLE:
            yield np.unique(hashes[ends[i] - (n - SHINGLE + 1):ends[i]])
        elif n:
            first = words.first[i:i + 1]
            yield whole(first, first + n)
        else:
            yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set; those of a union are the larger ones."""
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 2048):
        part = shingles[at:at + 2048]
        halves = (part & np.uint64(0xFFFFFFFF)).astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        for odd, half in enumerate(halves):
            drawn = _FACTOR[odd::2, None] * half + _SHIFT[odd::2, None]
            np.minimum(least[odd::2], drawn.min(axis=1), out=least[odd::2])
    exponential = -np.log1p(-(least + 0.5) / 2.0**32)
    level = np.floor(1 - np.log(exponential / RATE) / np.log(BASE))
    return np.clip(level, 0, TOP + 1).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A key per band of each row of registers."""
    keys = np.broadcast_to(_BAND_SEED, (len(sketches), BANDS)).copy()
    bands = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        keys = T.mix(keys + bands[:, :, i])
    return keys


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches, sizes known.

    The counts of larger, smaller and equal registers are multinomial; their likelihood is
    read at every hundredth of the possible range.
    """
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101) * np.minimum(u / v, v / u)

    def share(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = share(u - v * j), share(v - u * j)
    even = np.maximum(1 - up - down, 1e-12)
    likelihood = (
        above * np.log(np.maximum(up, 1e-12)) + below * np.log(np.maximum(down, 1e-12))
        + (a.shape[1] - above - below) * np.log(even)
    )
    best = likelihood.argmax(axis=1)
    return j[np.arange(len(j)), best]


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in T.chunks(batch.column("text")):
            size, one, two, sketch = [], [], [], []
            for shingles in shingle_sets(data, offsets):
                size.append(len(shingles))
                one.append(int(shingles.sum()))
                two.append(int(T.mix(shingles ^ np.uint64(0x5BD1E995)).sum()))
                sketch.append(registers(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, end - first),
                    pa.array(size, pa.int64()),
                    pa.array(np.array(one, np.uint64).view(np.int64)),
                    pa.array(np.array(two, np.uint64).view(np.int64)),
                    pa.array(sketch, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_id", "set_check", "sketch"],
            )


def sketch_documents(docs: DataFrame) -> DataFrame:
    """Per document: set size, two sums of hashes that name the set, and the registers."""
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _sketch_batches,
        f"doc_id {key}, n_shingles long, set_id long, set_check long, sketch binary",
    )


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16)
        keys = band_keys(sketches.reshape(-1, REGISTERS))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys.ravel().view(np.int64)),
                pa.array(np.repeat(batch.column("set_id").to_numpy(), BANDS)),
            ],
            names=["band", "set_id"],
        )


def _likely_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            a, b = (
                np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for c in ("sketch_a", "sketch_b")
            )
            n_a, n_b = part.column("n_a").to_numpy(), part.column("n_b").to_numpy()
            likely = estimate(a, b, n_a, n_b) >= LEAST_ESTIMATE
            yield part.select(["a", "b"]).filter(pa.array(likely))


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in T.chunks(batch.column("text")):
            wanted = batch.column("set_id").slice(first, end - first).to_pylist()
            ids, sets = [], []
            for name, shingles in zip(wanted, shingle_sets(data, offsets)):
                if int(shingles.sum().view(np.int64)) == name:
                    ids.append(name)
                    sets.append(shingles.view(np.int64))
            bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))],
                names=["set_id", "shingles"],
            )


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each end of an edge, its root the least node it reaches.

    Alternating large and small stars: every node hands its greater neighbours, then its
    lesser ones, to the least that it knows. Each step joins on one end of an edge and is
    written out; the last leaves every node with one root that is no one's child.
    """
    edges = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a != b").distinct(), "edges",
    )
    while not _are_stars(edges):
        ways = _both(edges)
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = ways.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
        edges = stage(small.distinct(), "small-star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    roles = edges.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root"))
    )
    mixed = roles.groupBy("n").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return mixed.filter("child + root > 1").isEmpty()


def _sketched_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` that their sizes and the likelihood of their sketches let pass."""
    a = classes.select(
        F.col("set_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a")
    )
    b = classes.select(
        F.col("set_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b")
    )
    sized = pairs.join(a.drop("sketch_a"), "a").join(b.drop("sketch_b"), "b").filter(
        100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    )
    held = sized.join(a.drop("n_a"), "a").join(b.drop("n_b"), "b")
    return held.mapInArrow(_likely_batches, "a long, b long")


def shingle_sets_of(docs: DataFrame, classes: DataFrame, names: DataFrame) -> DataFrame:
    """``(set_id, shingles)`` of the named classes, from the text of one document of each."""
    wanted = classes.join(names, "set_id", "left_semi").select(F.col("first_doc").alias("doc_id"), "set_id")
    wanted = stage(wanted, "wanted-documents")
    texts = only_keys(docs.select("doc_id", "text"), "doc_id", wanted).join(wanted, "doc_id")
    return texts.select("set_id", "text").mapInArrow(_set_batches, "set_id long, shingles array<long>")


def confirm(likely: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among pairs ``(a, b)``, on full sets."""
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    found = likely.join(left, "a").join(right, "b").filter(100 * shared >= PERCENT * union)
    return stage(found.select("a", "b"), "links")


def _block_links(block: pd.DataFrame) -> pd.DataFrame:
    """Links between the outsiders and the members of a block, one per outsider and root."""
    sets = block["shingles"].tolist()
    size = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    ids, roots = block["set_id"].to_numpy(), block["root"].to_numpy()
    member = np.flatnonzero(~block["outside"].to_numpy())
    flat = np.concatenate([place[first[m]:first[m] + size[m]] for m in member]) if len(member) else place[:0]
    begin = np.cumsum(size[member]) - size[member]
    held = np.zeros(len(values), bool)
    found: dict[tuple[int, int], int] = {}
    for o in np.flatnonzero(block["outside"].to_numpy()) if len(member) else ():
        mine = place[first[o]:first[o] + size[o]]
        held[mine] = True
        shared = np.add.reduceat(held[flat], begin, dtype=np.int64)
        held[mine] = False
        near = 100 * shared >= PERCENT * (size[o] + size[member] - shared)
        for m in member[near & (roots[member] != roots[o])]:
            found[int(ids[o]), int(roots[m])] = int(ids[m])
    return pd.DataFrame([(o, m) for (o, _), m in found.items()], columns=["a", "b"])


def links_of_outsiders(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between classes of one group and different roots, given
    ``grouped(set_id, node_group, root)``.

    The classes of a group's most common root are linked already; all others are outsiders
    and are compared with the whole group, on full sets. Outsiders and members are split
    into blocks, and each pair of blocks is a task: a group of any size is never gathered,
    and its pairs are never rows.
    """
    held = grouped.groupBy("node_group", "root").agg(F.count(F.lit(1)).alias("held"))
    facts = held.groupBy("node_group").agg(
        F.max_by("root", F.struct("held", "root")).alias("main"), F.sum("held").alias("n"),
        (F.sum("held") - F.max("held")).alias("n_outside"),
    ).filter("n_outside > 0")
    facts = stage(facts.select(
        "node_group", "main",
        F.ceil(F.col("n") / BLOCK).alias("m_blocks"),
        F.ceil(F.col("n_outside") / BLOCK).alias("o_blocks"),
    ), "open-groups")
    rows = stage(grouped.join(facts, "node_group").join(sets, "set_id"), "open-classes")

    def blocks(count: str):
        return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)

    def own(count: str):
        return F.pmod(F.xxhash64("set_id"), F.col(count))

    columns = ["node_group", "set_id", "root", "shingles"]
    members = rows.select(
        *columns, own("m_blocks").alias("m"), F.explode(blocks("o_blocks")).alias("o"),
        F.lit(False).alias("outside"),
    )
    outsiders = rows.filter("root != main").select(
        *columns, F.explode(blocks("m_blocks")).alias("m"), own("o_blocks").alias("o"),
        F.lit(True).alias("outside"),
    )
    found = members.union(outsiders).groupBy("node_group", "m", "o").applyInPandas(
        _block_links, "a long, b long"
    )
    return stage(found, "outsider-links")


def _block_ties(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
    """The classes of blocks of rows that are likely to be linked with one of another root,
    and ties between those roots, given where each block begins and where the last ends.

    A row is ``outer`` if it meets the others of its block, ``inner`` if they meet it. A tie is
    given where it joins what was apart in its block: no more ties than rows.
    """
    ids, roots, n = (rows.column(c).to_numpy() for c in ("set_id", "root", "n_shingles"))
    outer = rows.column("outer").to_numpy(zero_copy_only=False)
    inner = rows.column("inner").to_numpy(zero_copy_only=False)
    sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    involved = np.zeros(len(ids), bool)
    ties: list[tuple[int, int, int]] = []
    for start, end in zip(first[:-1].tolist(), first[1:].tolist()):
        others = np.flatnonzero(inner[start:end]) + start
        label = roots[start:end].copy()
        for x in (np.flatnonzero(outer[start:end]) + start).tolist():
            small, large = np.minimum(n[x], n[others]), np.maximum(n[x], n[others])
            near = others[(roots[others] != roots[x]) & (100 * small >= PERCENT * large)]
            if len(near):
                # Equal registers are few where sets differ much; the likelihood judges the rest.
                equal = np.count_nonzero(sketches[near] == sketches[x], axis=1)
                near = near[equal >= LEAST_EQUAL]
            if not len(near):
                continue
            mine = np.broadcast_to(sketches[x], (len(near), REGISTERS))
            near = near[estimate(mine, sketches[near], np.full(len(near), n[x]), n[near]) >= LEAST_ESTIMATE]
            if len(near):
                involved[near] = involved[x] = True
                own = label[x - start]
                apart, at = np.unique(label[near - start], return_index=True)
                for other, y in zip(apart.tolist(), near[at].tolist()):
                    if other != own:
                        ties.append((int(ids[x]), int(roots[x]), int(roots[y])))
                        label[label == other] = own
    at = np.flatnonzero(involved)
    ties += zip(ids[at].tolist(), roots[at].tolist(), roots[at].tolist())
    columns = zip(*ties) if ties else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["set_id", "root", "other"])


def _open_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ties of the blocks of open buckets, which come one after the other."""
    held: list[pa.RecordBatch] = []
    n = 0

    def flush(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = np.stack([rows.column(c).to_numpy() for c in ("band", "i", "j")], axis=1)
        edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        # The last block may go on.
        end = len(keys) if whole else int(edge[-1]) if len(edge) else 0
        if end:
            yield _block_ties(rows.slice(0, end), np.unique([0, *edge[edge < end], end]))
        held, n = [rows.slice(end)] if end < len(keys) else [], len(keys) - end

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n >= 2 * BLOCK:
                yield from flush(False)
    if held:
        yield from flush(True)


def open_classes(members: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """``(set_id, node_group, root)`` of classes that share a bucket with a class of another
    root and are likely to be linked with it, given ``members(band, set_id)`` and
    ``roots(node, root)``. Roots that such pairs tie together are a group.

    Only buckets of several roots are opened, and only the classes outside a bucket's most
    common root meet all of it. Both are split into blocks that meet as tasks, so a bucket of
    any size is never gathered; only sketches are compared.
    """
    rooted = members.join(roots, members["set_id"] == roots["node"], "left").select(
        "band", "set_id", F.coalesce("root", "set_id").alias("root")
    )
    rooted = stage(rooted, "rooted-members")
    held = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("held"))
    facts = held.groupBy("band").agg(
        F.max_by("root", F.struct("held", "root")).alias("main"), F.sum("held").alias("n"),
        (F.sum("held") - F.max("held")).alias("n_outside"),
    ).filter("n_outside > 0")
    facts = stage(facts.select(
        "band", "main",
        F.ceil(F.col("n") / BLOCK).alias("m_blocks"), F.ceil(F.col("n_outside") / BLOCK).alias("o_blocks"),
    ), "open-buckets")
    rows = rooted.join(facts, "band").join(classes.select("set_id", "n_shingles", "sketch"), "set_id")

    def own(count: str):
        return F.pmod(F.xxhash64("set_id"), F.col(count))

    def all_of(count: str):
        return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)

    outside = F.col("root") != F.col("main")
    # A class is a member in one block of them, and an outsider in one block of those: where
    # the two meet in one task, one row is both.
    places = F.array_union(
        F.transform(all_of("o_blocks"), lambda o: F.struct(own("m_blocks").alias("i"), o.alias("j"))),
        F.when(outside, F.transform(all_of("m_blocks"), lambda m: F.struct(m.alias("i"), own("o_blocks").alias("j"))))
        .otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>")),
    )
    rows = rows.select("*", F.inline(places)).select(
        "band", "i", "j", "set_id", "root", "n_shingles", "sketch",
        (outside & (F.col("j") == own("o_blocks"))).alias("outer"), (F.col("i") == own("m_blocks")).alias("inner"),
    )
    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    ties = dealt.mapInArrow(_open_batches, "set_id long, root long, other long")
    ties = stage(ties.distinct(), "root-ties")
    groups = components(ties.filter("root != other").select(F.col("root").alias("a"), F.col("other").alias("b")))
    involved = ties.select("set_id", F.col("root").alias("node")).distinct()
    return involved.join(groups.withColumnRenamed("root", "node_group"), "node").select(
        "set_id", "node_group", F.col("node").alias("root")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: set size, the least document it reaches by links, and whether
    it is that one.

    A text without words, null or empty, has an empty set and reaches itself alone; a null
    key reaches null and is kept; rows that repeat a key with other texts are judged by
    their own text; an empty table gives an empty result; other columns are ignored.
    """
    sketched = stage(sketch_documents(docs), "sketches")
    full = sketched.filter("n_shingles > 0")
    classes = full.groupBy("set_id", "set_check").agg(
        F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"),
    )
    classes = stage(classes, "classes")
    bands = classes.select("set_id", "sketch").mapInArrow(_band_batches, "band long, set_id long")
    pivots = bands.groupBy("band").agg(
        F.min("set_id").alias("pivot"), F.max("set_id").alias("last")
    ).filter("pivot != last").drop("last")
    members = stage(bands.join(stage(pivots, "buckets"), "band").select("band", "set_id", "pivot"), "members")
    candidates = stage(
        classes.join(members.select("set_id").distinct(), "set_id", "left_semi"), "candidate-classes"
    )

    def sets_of(names: DataFrame) -> DataFrame:
        return stage(shingle_sets_of(docs, candidates, names.select("set_id").distinct()), "shingle-sets")

    # All of a bucket meet its pivot; then those still apart meet the rest of their bucket.
    pairs = members.filter("set_id != pivot").select(
        F.col("pivot").alias("a"), F.col("set_id").alias("b")
    ).distinct()
    likely = stage(_sketched_pairs(pairs, candidates), "likely-pairs")
    links = confirm(likely, sets_of(_both(likely).withColumnRenamed("a", "set_id")))
    apart = stage(open_classes(members, components(links), candidates), "open-classes-by-group")
    links = links.union(links_of_outsiders(apart, sets_of(apart)))
    roots = components(links)
    reach = classes.select("set_id", "first_doc").join(
        roots, classes["set_id"] == roots["node"], "left"
    ).select("set_id", "first_doc", F.coalesce("root", "set_id").alias("root"))
    reach = stage(reach, "reach")
    least = reach.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    known = stage(reach.join(least, "root").select("set_id", "component_id"), "components")
    found = sketched.select("doc_id", "n_shingles", "set_id").join(known, "set_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group; rows that repeat its key all stay.

    The dropped keys are joined and not the kept ones: they are the fewer, and never null.
    """
    judged = stage(near_duplicates(docs).select("doc_id", "kept"), "judged-documents")
    gone = judged.filter("NOT kept").select("doc_id").distinct()
    still = judged.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    gone = stage(gone.join(still, "doc_id", "left_anti"), "dropped-documents")
    return docs.join(gone, "doc_id", "left_anti")
