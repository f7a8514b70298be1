"""A Gaussian mixture whose result does not depend on how the rows are partitioned.

Each step of expectation and maximisation is one pass over blocks of rows that stay with the
executors. What it sums is rounded to whole numbers of a small unit first, and sums of whole
numbers come out the same in any order. The start follows from exact moments and quantiles of
the rows and not from a draw.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.operators.blocks import Sums, numpy_blocks, summed
from demandlake.operators.ranks import quantiles

# Steps from each start before the best one is chosen.
TRIAL_STEPS = 4
# A sum's unit: rows add whole numbers of 2**-40.
_UNIT = 2.0**40
_WHOLE = "decimal(38,0)"
# Added to the variances, which a component on a single point would else lose; and the share
# of the rows below which a component has none.
_LEAST_VARIANCE, _LEAST_WEIGHT = 1e-6, 1e-9


@dataclass(frozen=True)
class Mixture:
    """Columns are scaled by ``mean`` and ``deviation`` first; components are in the order of
    their mean of the last column, and of the ones before it on a tie."""

    columns: tuple[str, ...]
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float
    steps: int


def _sum(value: Column) -> Column:
    return F.sum(F.round(value * _UNIT).cast(_WHOLE))


def _moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and sample deviation of exact sums; a constant column deviates by 1."""
    exact = [F.col(c).cast("decimal(18,4)") for c in columns]
    row = df.agg(
        F.count(F.lit(1)), *[F.sum(x) for x in exact], *[F.sum((x * x).cast("decimal(38,8)")) for x in exact]
    ).first()
    n, d = row[0], len(columns)
    if not n:
        return 0, np.zeros(d), np.ones(d)
    sums, squares = row[1:1 + d], row[1 + d:]
    mean = np.array([float(s / n) for s in sums])
    # Subtracted while still exact.
    variance = [float((q - s * s / n) / max(n - 1, 1)) for s, q in zip(sums, squares)]
    deviation = np.sqrt(np.maximum(variance, 0))
    return n, mean, np.where(deviation > 0, deviation, 1.0)


def _scaled(columns: Sequence[str], mean: np.ndarray, deviation: np.ndarray) -> list[Column]:
    return [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(columns, mean, deviation)]


def _log_densities(x: Sequence, weights, means, covariances, square: Callable) -> list:
    """Per component, the logarithm of its weight times its density, of columns or of arrays."""
    found = []
    for weight, mean, covariance in zip(weights, means, covariances):
        half = np.linalg.inv(np.linalg.cholesky(covariance))
        apart = [x[j] - float(mean[j]) for j in range(len(x))]
        quadratic = reduce(add, [
            square(reduce(add, [apart[j] * float(half[i, j]) for j in range(i + 1)])) for i in range(len(x))
        ])
        log_scale = math.log(weight) + float(np.log(np.diag(half)).sum()) - len(x) / 2 * math.log(2 * math.pi)
        found.append(log_scale - quadratic / 2)
    return found


def _exact_sum(values: np.ndarray) -> int:
    """The sum of the values as whole numbers of a unit, halves rounded away from 0."""
    whole = values * _UNIT
    whole = np.where(np.abs(whole) < 2.0**52, np.copysign(np.floor(np.abs(whole) + 0.5), whole), whole)
    # In two parts, each of which is exact in 64 bits.
    high = np.floor(whole / 2**20)
    return (int(high.astype(np.int64).sum()) << 20) + int((whole - high * 2**20).astype(np.int64).sum())


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(d) for b in range(a + 1)]


def _square(values: Sequence[float], d: int) -> np.ndarray:
    out = np.zeros((d, d))
    for (a, b), value in zip(_pairs(d), values):
        out[a, b] = out[b, a] = value
    return out


def _expected(logs: Callable[[np.ndarray], Sequence[np.ndarray]], centres: np.ndarray) -> Callable[[np.ndarray], Sums]:
    """Rows, log likelihood, and per component its shares of the rows with their moments."""
    k, d = centres.shape

    def expect(x: np.ndarray) -> Sums:
        found = logs(x)
        top = np.maximum(np.max(found, axis=0), -1e300)
        shares = [np.exp(log - top) for log in found]
        total = reduce(add, shares)
        sums = [x.shape[1], _exact_sum(top + np.log(total))]
        for i in range(k):
            r = shares[i] / total
            apart = [x[j] - float(centres[i, j]) for j in range(d)]
            sums += map(_exact_sum, [r, *[r * a for a in apart], *[r * apart[a] * apart[b] for a, b in _pairs(d)]])
        return Sums(sums)

    return expect


def _maximise(blocks: RDD, logs: Callable[[np.ndarray], Sequence[np.ndarray]], centres: np.ndarray):
    """The components that fit best where row and component belong together as ``logs`` say,
    and the log likelihood per row of ``logs``; products are taken around ``centres``."""
    k, d = centres.shape
    row = [float(v) for v in summed(blocks, _expected(logs, centres))]
    n, likelihood = row[0], row[1] / _UNIT / row[0]
    each = 1 + d + len(_pairs(d))
    weights, means, covariances = [], [], []
    for i in range(k):
        part = np.array(row[2 + i * each:2 + (i + 1) * each]) / _UNIT
        weights.append(max(part[0] / n, _LEAST_WEIGHT))
        if part[0] / n < _LEAST_WEIGHT:
            # A component of nothing stays where it is.
            means.append(centres[i])
            covariances.append(np.eye(d))
            continue
        shift = part[1:1 + d] / part[0]
        means.append(centres[i] + shift)
        covariance = _square(part[1 + d:], d) / part[0] - np.outer(shift, shift)
        covariances.append(covariance + _LEAST_VARIANCE * np.eye(d))
    return (np.array(weights), np.array(means), np.array(covariances)), likelihood


def _start(rows: DataFrame, blocks: RDD, covariance: np.ndarray, axis: int, k: int):
    """Components from ``k`` slices of equally many rows along a principal axis."""
    d = len(covariance)
    values, vectors = np.linalg.eigh(covariance)
    direction = vectors[:, np.argsort(-values, kind="stable")[axis]]

    def place(x: Sequence):
        return reduce(add, [x[j] * float(direction[j]) for j in range(d)])

    along = place([F.col(f"z{j}") for j in range(d)])
    cuts = quantiles(rows.select(along.alias("place")), "place", [i / k for i in range(1, k)])
    bounds = [-math.inf, *cuts, math.inf]

    def logs(x: np.ndarray) -> list[np.ndarray]:
        at = place(x)
        return [np.where((at > low) & (at <= high), 0.0, -1e6) for low, high in zip(bounds, bounds[1:])]

    return _maximise(blocks, logs, np.zeros((k, d)))[0]


def _densities(state) -> Callable[[np.ndarray], list[np.ndarray]]:
    return lambda x: _log_densities(x, *state, np.square)


def _pack(batch: pa.RecordBatch) -> np.ndarray:
    """``values[column, row]``"""
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def fit_mixture(
    df: DataFrame, columns: Sequence[str], k: int = 4, tol: float = 1e-3, most_steps: int = 100
) -> Mixture | None:
    """The mixture from the best of the starts, which are slices along each principal axis;
    None without rows.

    ``df`` should be stored, for it is read some times before its blocks are kept. Steps end when the log likelihood
    per row rises by less than ``tol``. Columns must not be null.
    """
    d = len(columns)
    n, mean, deviation = _moments(df, columns)
    if not n:
        return None
    rows = df.select(*[c.alias(f"z{j}") for j, c in enumerate(_scaled(columns, mean, deviation))])
    x = [F.col(f"z{j}") for j in range(d)]
    products = rows.agg(*[_sum(x[a] * x[b]) for a, b in _pairs(d)]).first()
    covariance = _square([float(v) / _UNIT / n for v in products], d) + _LEAST_VARIANCE * np.eye(d)

    def rise(state, last: float, steps: int, most: int):
        """Steps until the likelihood hardly rises, or there were ``most``."""
        while True:
            following, likelihood = _maximise(blocks, _densities(state), state[1])
            if likelihood - last < tol or steps >= most:
                return state, likelihood, steps
            state, last, steps = following, likelihood, steps + 1

    blocks = numpy_blocks(rows, _pack)
    # A few steps from each start show which one leads highest; it alone goes on.
    tried = [rise(_start(rows, blocks, covariance, axis, k), -math.inf, 0, min(TRIAL_STEPS, most_steps)) for axis in range(d)]
    state, likelihood, steps = max(tried, key=lambda t: t[1])
    if TRIAL_STEPS <= steps < most_steps:
        state, likelihood, steps = rise(state, -math.inf, steps, most_steps)
    blocks.unpersist()
    weights, means, covariances = state
    order = np.lexsort(means.T)
    return Mixture(
        tuple(columns), mean, deviation, weights[order], means[order], covariances[order], likelihood, steps
    )


def assign(df: DataFrame, model: Mixture, name: str = "cluster") -> DataFrame:
    """``df`` with the likeliest component of each row; the first of equal ones."""
    x = _scaled(model.columns, model.mean, model.deviation)
    square = partial(F.pow, col2=F.lit(2.0))
    logs = F.array(*_log_densities(x, model.weights, model.means, model.covariances, square))
    return df.withColumn("__logs", logs).withColumn(
        name, (F.array_position("__logs", F.array_max("__logs")) - 1).cast("int")
    ).drop("__logs")
