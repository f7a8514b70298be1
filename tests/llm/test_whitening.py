"""Whitening against an eigendecomposition in plain numpy, and on edge inputs."""

import math
from collections import Counter

import numpy as np
import pytest

from demandlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, steps string, dimension int"
WIDTH = 20


def plain(rows, most=16):
    """``{(vec_id, component): (n, deviation, |whitened|, explained)}`` of contract rows."""
    kept = []
    for key, vector in rows:
        if vector is not None and all(c is not None and math.isfinite(c) for c in vector):
            kept.append((key, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]))
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = Counter()
    for key, x in kept:
        apart = [n * c - s for c, s in zip(x, sums)]
        deviation = sum(a * a for a in apart)
        for i in range(min(most, len(e))):
            if e[i] > e.sum() * 1e-13:
                w = float(np.array(apart) / n @ u[:, i] / math.sqrt(e[i]))
                out[key, i + 1, n, deviation, round(abs(w), 6), round(e[i] / e.sum(), 9)] += 1
    return out


def found(df):
    rows = df.collect()
    assert all(r["identity_error"] <= 1e-9 for r in rows)
    return Counter(
        (r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6), round(r["explained"], 9))
        for r in rows
    )


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, WIDTH)) @ np.diag(np.geomspace(3, 0.05, WIDTH)) @ rng.normal(size=(WIDTH, WIDTH))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate((mixed + 5).astype(np.float32))]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # one vector many times
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    bad = rows[0][1]
    rows += [(2000, None), (2001, [None, *bad[1:]]), (2002, [float("nan"), *bad[1:]]),
             (2003, [*bad[:-1], float("inf")]), (2004, [float("-inf"), *bad[1:]])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "s", 2) for k, v in rows], SCHEMA).repartition(5)


def test_components(spark, vectors):
    assert found(whitening.whitened_components(frame(spark, vectors))) == plain(vectors)


def test_signs_are_those_of_one_component(spark, vectors):
    rows = whitening.whitened_components(frame(spark, vectors)).collect()
    again = whitening.whitened_components(frame(spark, vectors)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_lengths_and_huge_entries(spark, vectors):
    """The commonest length counts; entries without an exact number of steps pass over."""
    odd = [(3000, [1.0, 2.0]), (3001, []), (3002, [1e30] * WIDTH)]
    assert found(whitening.whitened_components(frame(spark, vectors + odd))) == plain(vectors)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2 ** (20 + i)), float(i), -3e9 * i]) for i in range(12)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened_components(frame(spark, rows)).collect()}
    kept = {i: [math.floor(64 * float(np.float32(c))) for c in v] for i, v in rows}
    sums = [sum(c) for c in zip(*kept.values())]
    for i, steps in kept.items():
        exact = sum((12 * c - s) ** 2 for c, s in zip(steps, sums))
        assert got[i] == (exact if exact < 2**63 else None)


def test_without_variance(spark):
    """Fewer directions than entries give fewer components; one vector gives none."""
    flat = [(i, [float(i % 5), 2.0, float(-(i % 5))]) for i in range(9)]
    assert found(whitening.whitened_components(frame(spark, flat))) == plain(flat)
    assert {c[1] for c in plain(flat)} == {1}
    assert whitening.whitened_components(frame(spark, flat[:1] * 3)).count() == 0
    none = whitening.whitened_components(frame(spark, [(1, None)]).limit(0))
    assert none.count() == 0
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_jacobi_keeps_small_eigenvalues():
    """Relative accuracy, also of eigenvalues 1e12 below the largest."""
    rng = np.random.default_rng(1)
    scales = np.geomspace(1, 1e-6, 12)
    basis, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    factor = np.tril(np.linalg.qr((basis * scales).T)[1].T)
    e, u = whitening.one_sided_jacobi(factor)
    assert np.allclose(e, scales**2, rtol=1e-9)
    assert np.abs(u.T @ u - np.eye(12)).max() < 1e-13
    g = whitening.pivoted_cholesky(factor @ factor.T)
    assert np.allclose(g @ g.T, factor @ factor.T, atol=1e-15)
