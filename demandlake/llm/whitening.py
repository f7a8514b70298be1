"""Embedding whitening by pivoted Cholesky and one-sided Jacobi rotations.

Entries are quantised to whole numbers, so equal vectors are told exactly and sums are exact.
The centred scatter of the distinct vectors is summed in Spark, a row of it at a time. The
driver only meets that one matrix, whose size follows the dimension and not the table: it is
factored by Cholesky with diagonal pivots, and rotations applied to the columns of the factor
make them orthogonal. The squares of their lengths are then the eigenvalues and the columns
themselves, normalised, the components; the scatter's product is never diagonalised, which
would square its condition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import text as T
from demandlake.llm.tables import stage, table

STEPS = 64  # quantisation steps of a unit
SHIFT = 1_000_000
COMPONENTS = 16
# Entries beyond this have no exact whole number of steps in a double.
LARGEST = float(1 << 46)
MOST_SWEEPS = 60
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)
_LONG_MAX = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``sums`` are those of the steps ``floor(64 * c)`` of the ``n``
    distinct vectors; ``components`` are columns, by falling eigenvalue."""

    dimension: int
    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """``g`` with ``g @ g.T`` equal to the scatter, as many columns as its numerical rank;
    triangular once its rows are put in the order of the pivots."""
    size = len(scatter)
    rest = np.diag(scatter).astype(float).copy()
    least = size * np.finfo(float).eps * rest.max(initial=0.0)
    g = np.zeros((size, size))
    for k in range(size):
        pivot = int(rest.argmax())
        if rest[pivot] <= least:
            return g[:, :k]
        column = (scatter[:, pivot] - g[:, :k] @ g[pivot, :k]) / np.sqrt(rest[pivot])
        # Rows that were pivots before are zero in exact arithmetic.
        column[rest == -np.inf] = 0.0
        g[:, k] = column
        rest = rest - column * column
        rest[pivot] = -np.inf
    return g


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths, falling, and directions of the columns of ``factor`` after rotations
    that make them orthogonal. A sweep meets all pairs, a half of the columns with the other
    half at a time, as in a tournament."""
    rank = factor.shape[1]
    g = np.hstack([factor, np.zeros((len(factor), rank % 2))])
    seats = np.arange(g.shape[1])
    half = len(seats) // 2
    small = np.finfo(float).eps * np.sqrt(max(1, len(factor)))
    for _ in range(MOST_SWEEPS):
        turned = False
        for _ in range(max(1, len(seats) - 1) if half else 0):
            p, q = seats[:half], seats[half:][::-1]
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            open_ = np.abs(ab) > small * np.sqrt(aa * bb)
            if open_.any():
                turned = True
                p, q, a, b = p[open_], q[open_], a[:, open_], b[:, open_]
                zeta = (bb[open_] - aa[open_]) / (2 * ab[open_])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                g[:, p], g[:, q] = c * a - c * t * b, c * t * a + c * b
            seats[1:] = np.roll(seats[1:], 1)
        if not turned:
            break
    lengths = (g * g).sum(0)
    order = np.argsort(-lengths, kind="stable")[:rank]
    return lengths[order], g[:, order] / np.sqrt(lengths[order])


def _steps(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, steps)`` of the usable vectors of each length: their places and a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    first = np.concatenate(([0], np.cumsum(sizes)))
    # A null entry has become a NaN; comparisons with it are false.
    bad = T.per_text(~(np.abs(values) < LARGEST), first)
    usable = (bad == 0) & (sizes > 0)
    for size in np.unique(sizes[usable]).tolist():
        rows = np.flatnonzero(usable & (sizes == size))
        at = first[rows][:, None] + np.arange(size)
        yield rows, np.floor(STEPS * values[at]).astype(np.int64)


def _coded(steps: np.ndarray) -> list[bytes]:
    """Each row in the narrowest whole numbers that hold it."""
    most, least = steps.max(axis=1), steps.min(axis=1)
    coded = [b""] * len(steps)
    left = np.ones(len(steps), bool)
    for width in _WIDTHS:
        info = np.iinfo(width)
        fits = left & (most <= info.max) & (least >= info.min)
        left &= ~fits
        for row, values in zip(np.flatnonzero(fits).tolist(), steps[fits].astype(width)):
            coded[row] = values.tobytes()
    return coded


def _decoded(column: pa.Array, dimension: int) -> np.ndarray:
    out = np.empty((len(column), dimension), np.int64)
    for i, raw in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(raw, f"<i{len(raw) // dimension}")
    return out


def _vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, steps in _steps(batch.column("embedding")):
            yield pa.RecordBatch.from_arrays(
                [pa.array([steps.shape[1]] * len(steps), pa.int32()), pa.array(_coded(steps), pa.binary())],
                names=["dimension", "steps"],
            )


def _sum_batches(dimension: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dimension, 0
        for batch in batches:
            steps = _decoded(batch.column("steps"), dimension)
            n += len(steps)
            # In two halves, neither of which can overflow within a batch.
            high, low = (steps >> 32).sum(axis=0).tolist(), (steps & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + s for t, h, s in zip(total, high, low)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dimension + 1), pa.int32()),
                 pa.array([Decimal(t) for t in [*total, n]], pa.decimal128(38, 0))],
                names=["i", "total"],
            )

    return sums


def _product_batches(dimension: int, mean: np.ndarray, projection: np.ndarray | None, offset: np.ndarray):
    """Rows of the products of centred vectors, projected if asked to, and their sums as the
    last row, of each task."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = dimension if projection is None else projection.shape[1]
        sums, n = np.zeros((width + 1, width)), 0
        for batch in batches:
            centred = _decoded(batch.column("steps"), dimension) - mean
            if projection is not None:
                centred = centred @ projection
            centred = centred - offset
            sums[:width] += centred.T @ centred
            sums[width] += centred.sum(axis=0)
            n += len(centred)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width + 1), pa.int32()), pa.array([row.tobytes() for row in sums], pa.binary())],
                names=["i", "values"],
            )

    return products


def _added_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each ``i``; rows come ordered by it, so a task holds a single sum."""
    last, held = None, None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([last], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["i", "values"]
        )

    for batch in batches:
        for i, raw in zip(batch.column("i").to_pylist(), batch.column("values").to_pylist()):
            if i != last and last is not None:
                yield row()
                held = None
            values = np.frombuffer(raw)
            last, held = i, values.copy() if held is None else held + values
    if held is not None:
        yield row()


def _products(fit: DataFrame, dimension: int, mean, projection=None, offset=0.0) -> np.ndarray:
    """The summed products, a square matrix, and below them the summed vectors."""
    kind = "i int, values binary"
    parts = fit.mapInArrow(_product_batches(dimension, mean, projection, np.asarray(offset)), kind)
    # Ordered by content as well: sums of doubles come out the same in every run.
    added = parts.repartition("i").sortWithinPartitions("i", "values").mapInArrow(_added_batches, kind)
    return np.array([np.frombuffer(r["values"]) for r in sorted(added.collect())])


def _vectors(embeddings: DataFrame, *columns: str) -> DataFrame:
    return embeddings.select(*columns, F.col("embedding").cast("array<double>").alias("embedding"))


def fit_whitening(embeddings: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct quantised vectors of ``embeddings``; None without any.

    Null and empty vectors, and those with null, non-finite or huge entries (2**46 and more),
    are passed over; of several lengths the one that most distinct vectors have counts, the
    longest on a tie. Directions without variance have no component.
    """
    fit = _vectors(embeddings).mapInArrow(_vector_batches, "dimension int, steps binary").distinct()
    fit = stage(fit, "fit-vectors")
    common = fit.groupBy("dimension").count().orderBy(F.desc("count"), F.desc("dimension")).first()
    if common is None:
        return None
    dimension = common["dimension"]
    fit = fit.filter(F.col("dimension") == dimension).select("steps")
    sums = fit.mapInArrow(_sum_batches(dimension), "i int, total decimal(38,0)")
    totals = {r["i"]: int(r["total"]) for r in sums.groupBy("i").agg(F.sum("total").alias("total")).collect()}
    n, totals = totals[dimension], tuple(totals[i] for i in range(dimension))
    mean = np.array([t / n for t in totals])

    products = _products(fit, dimension, mean)
    rest = products[dimension] / n  # what rounding has left of the mean
    scatter = products[:dimension] - n * np.outer(rest, rest)
    eigenvalues, components = one_sided_jacobi(pivoted_cholesky(scatter))
    eigenvalues, components = eigenvalues[:most] / n, components[:, :most]
    largest = components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])]
    components = components * np.where(largest < 0, -1.0, 1.0)

    projection = components / np.sqrt(eigenvalues)
    width = len(eigenvalues)
    error = 0.0
    if width:
        covariance = _products(fit, dimension, mean, projection, rest @ projection)[:width] / n
        error = float(np.abs(covariance - np.eye(width)).max())
    return Whitening(dimension, n, totals, eigenvalues, components, float(np.trace(scatter)) / n, error)


def _deviations(steps: np.ndarray, model: Whitening) -> list[int | None]:
    """The sums of ``(n * x - S) ** 2``, exact; null beyond a long."""
    sums = np.array(model.sums, object)
    widest = float(np.abs(steps).max(initial=0)) * model.n + float(np.abs(sums).max(initial=0))
    if widest * widest * model.dimension < 2.0**62:
        apart = model.n * steps - sums.astype(np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = model.n * steps.astype(object) - sums
    return [value if value <= _LONG_MAX else None for value in (apart * apart).sum(axis=1).tolist()]


def _whiten_batches(model: Whitening):
    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projection = model.mean, model.projection
        for batch in batches:
            for rows, steps in _steps(batch.column("embedding")):
                if steps.shape[1] != model.dimension:
                    continue
                values = (steps - mean) @ projection
                bounds = np.arange(len(rows) + 1, dtype=np.int32) * values.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)),
                        pa.array(_deviations(steps, model), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.ravel())),
                    ],
                    names=["vec_id", "deviation", "whitened"],
                )

    return whitened


def whiten(embeddings: DataFrame, model: Whitening) -> DataFrame:
    """Per usable vector of the model's length: key, deviation from the mean (null beyond a
    long), and the whitened vector, a value per component.

    A null key stays null and repeated rows are whitened each; an empty table gives an empty
    result; other columns are ignored.
    """
    key = embeddings.schema["vec_id"].dataType.simpleString()
    return _vectors(embeddings, "vec_id").mapInArrow(
        _whiten_batches(model), f"vec_id {key}, deviation long, whitened array<double>"
    )


def whitened_components(embeddings: DataFrame) -> DataFrame:
    """One row per usable vector and component; none where no vector varies."""
    model = fit_whitening(embeddings)
    if model is None:
        model = Whitening(1, 1, (0,), np.zeros(0), np.zeros((1, 0)), 1.0, 0.0)
    shares = [float(e / model.trace) for e in model.eigenvalues]
    explained = F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>")
    return whiten(embeddings, model).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def op11_cholesky_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))
