"""Boosting with patience, the mixture, exact quantiles and the sample."""

import math
import statistics
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demandlake import queries
from demandlake.operators import blocks, boosting, mixture, pricing, quality, ranks, retail, segment

# --- Boosting ------------------------------------------------------------------


@given(st.lists(st.floats(0, 10), max_size=120), st.integers(1, 40))
def test_best_round(curve, patience):
    kept, ended = boosting.best_round(curve, patience)
    if not curve:
        assert (kept, ended) == (0, False)
        return
    seen = curve[:kept + patience] if ended else curve
    # The first of the least errors, among the rounds that were looked at.
    assert kept == seen.index(min(seen)) + 1
    assert len(seen) - kept >= patience if ended else len(seen) - kept < patience
    # No earlier end: at each earlier round the best lay less than ``patience`` back.
    for n in range(1, len(seen)):
        assert n - (curve[:n].index(min(curve[:n])) + 1) < patience


def test_patience_outlasts_a_bump():
    curve = [5, 4, 4.5, 4.6, 3, 2, *[2.5] * 30, 1]
    assert boosting.best_round(curve, 30) == (6, True)
    assert boosting.best_round(curve, 1) == (2, True)
    assert boosting.best_round(curve, 31) == (37, False)


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, (1500, 3))
    y = np.where(x[:, 0] > 0, 3.0, 1.0) + x[:, 1] ** 2 + rng.normal(0, 0.3, 1500)
    rows = [(*map(float, v), float(t), i % 5 == 0) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, val boolean").repartition(3)


def test_boosting_rolls_back_to_its_best_round(spark, lines, tmp_path):
    model = boosting.fit_boosted(lines, ["a", "b", "c"], "y", "val", rounds=60, rate=0.5, depth=3, patience=4)
    kept, ended = boosting.best_round(model.curve, 4)
    assert ended and len(model.trees) == kept < len(model.curve)
    scored = lines.withColumn("p", model.predict())
    error = scored.where("val").select(F.avg((F.col("y") - F.col("p")) ** 2)).first()[0]
    assert error == pytest.approx(model.curve[kept - 1], rel=1e-9)
    assert model.curve[kept - 1] == min(model.curve[:kept + 4])
    plain = lines.where("val").select(F.var_pop("y")).first()[0]
    assert error < plain / 5
    model.save(spark, str(tmp_path / "model"))
    again = boosting.BoostedTrees.load(spark, str(tmp_path / "model"))
    x = np.random.default_rng(0).uniform(-3, 3, (200, 3))
    assert (again(x) == model(x)).all() and again.curve == model.curve and again.features == model.features


def test_boosting_without_validation_or_rows(spark, lines):
    marked = lines.withColumn("val", F.lit(False))
    model = boosting.fit_boosted(marked, ["a", "b"], "y", "val", rounds=3, depth=2)
    assert len(model.trees) == 3 and model.curve == ()
    none = boosting.fit_boosted(lines.limit(0), ["a", "b"], "y", "val", rounds=3)
    assert none.trees == () and none(np.zeros((2, 2))).tolist() == [0.0, 0.0]
    flat = boosting.fit_boosted(lines.withColumn("y", F.lit(2.0)), ["a", "b"], "y", "val", rounds=30)
    assert flat.trees == () and flat(np.zeros((1, 2))).tolist() == [2.0]


def test_boosting_is_the_same_in_any_partitioning(spark):
    """Of more rows than Spark ML takes its candidate splits from."""
    df = spark.range(12_000).selectExpr(
        "(id * 7919) % 10007 / 10007D AS a", "(id * 104729) % 9973 / 9973D AS b", "id % 6 = 0 AS val"
    ).selectExpr("*", "sin(7 * a) + b * b AS y")
    found = [
        boosting.fit_boosted(df.repartition(n), ["a", "b"], "y", "val", rounds=3, rate=0.5, depth=3) for n in (1, 5)
    ]
    for one, other in zip(*(m.trees for m in found)):
        assert (one.feature == other.feature).all() and (one.threshold == other.threshold).all()
        assert (one.value == other.value).all()
    assert found[0].curve == found[1].curve and len(found[0].curve) == 3


def test_a_round_is_a_pass_a_level(spark, lines):
    context = spark.sparkContext
    context.setJobGroup("boost", "")
    before = len(context.statusTracker().getJobIdsForGroup("boost"))
    boosting.fit_boosted(lines, ["a", "b"], "y", "val", rounds=20, depth=2)
    jobs = len(context.statusTracker().getJobIdsForGroup("boost")) - before
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 20 * 2 + 15


def test_candidate_splits():
    assert boosting.candidate_splits(np.array([2.0, 1.0, 2.0, 4.0])).tolist() == [1.5, 3.0]
    assert boosting.candidate_splits(np.ones(5)).tolist() == []
    even = boosting.candidate_splits(np.arange(6400.0))
    assert len(even) == boosting.BINS - 1 and set(np.diff(even)) <= {99.0, 100.0, 101.0}


# --- Mixture -------------------------------------------------------------------


@pytest.fixture(scope="module")
def customers(spark):
    rng = np.random.default_rng(2)
    rows, centres = [], [(10, 3, 100.0), (200, 2, 50.0), (30, 25, 900.0), (90, 12, 4000.0)]
    for i in range(900):
        r, f, m = centres[i % 4]
        rows.append((i, i % 4, int(abs(rng.normal(r, 8))), int(abs(rng.normal(f, 1))) + 1, round(abs(rng.normal(m, 20)), 2)))
    return spark.createDataFrame(rows, "customer_id long, truth int, recency int, frequency long, monetary double").cache()


def test_segments_do_not_depend_on_partitions(customers):
    found = []
    for n in (1, 3, 8):
        dealt = customers.repartition(n, F.xxhash64("customer_id", F.lit(n)))
        model = segment.fit_segments(dealt)
        found.append(sorted(map(tuple, segment.segment_customers(dealt, model).collect())))
        order = model.means[:, -1].tolist()
        assert order == sorted(order)
    assert found[0] == found[1] == found[2]
    clusters = dict(found[0])
    truth = {r["customer_id"]: r["truth"] for r in customers.collect()}
    pairs = {(truth[c], s) for c, s in clusters.items()}
    assert len(pairs) == 4 and len(set(clusters.values())) == 4


def test_mixture_steps_compile_no_plan(spark, customers):
    """Steps after the first run on kept blocks: a pass a step, whatever the components."""
    context = spark.sparkContext

    def jobs(steps: int) -> int:
        context.setJobGroup(f"mixture-{steps}", "")
        mixture.fit_mixture(customers, segment.RFM, 4, tol=-1.0, most_steps=steps)
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(f"mixture-{steps}"))

    few, many = jobs(5), jobs(11)
    assert many - few == 6


def test_exact_sums():
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1e4, 500), [2.0**30, -(2.0**-41), 3 * 2.0**-41, 0.0]])
    expected = sum(math.floor(abs(Fraction(v)) * 2**40 + Fraction(1, 2)) * (1 if v >= 0 else -1) for v in values.tolist())
    assert mixture._exact_sum(values) == expected


def test_mixture_is_a_maximum(customers):
    """Against the same steps in plain numpy, and the likelihood rises."""
    model = mixture.fit_mixture(customers, segment.RFM, 4)
    x = np.array([[r[c] for c in segment.RFM] for r in customers.collect()], float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.deviation, x.std(0, ddof=1))
    logs = np.stack([
        math.log(w) - 0.5 * np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m)
        - 0.5 * np.linalg.slogdet(2 * math.pi * c)[1]
        for w, m, c in zip(model.weights, model.means, model.covariances)
    ], axis=1)
    top = logs.max(1, keepdims=True)
    likelihood = float((top[:, 0] + np.log(np.exp(logs - top).sum(1))).mean())
    assert likelihood == pytest.approx(model.log_likelihood, abs=1e-6)
    shares = np.exp(logs - top)
    shares /= shares.sum(1, keepdims=True)
    assert np.allclose(shares.mean(0), model.weights, atol=0.02)


def test_segments_of_few_customers(spark, customers):
    none = segment.segment_customers(customers.limit(0), segment.fit_segments(customers.limit(0)))
    assert none.count() == 0 and none.columns == ["customer_id", "cluster"]
    same = spark.range(5).selectExpr("id AS customer_id", "1 AS recency", "2L AS frequency", "3D AS monetary")
    assert segment.segment_customers(same, segment.fit_segments(same)).select("cluster").distinct().count() == 1


# --- Quantiles -----------------------------------------------------------------


@settings(max_examples=200)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=30))
def test_places_keep_the_order(values):
    places = ranks._places(np.array(values)).tolist()
    for (a, p), (b, q) in zip(zip(values, places), list(zip(values, places))[1:]):
        assert (a < b) == (p < q) and (a == b) == (p == q)
    assert all(ranks._value(p) == v for p, v in zip(places, values))


def test_quantiles_of_a_continuous_column(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(0, 4, 5000), -rng.lognormal(0, 3, 3000), [0.0, -0.0, 1e300, -1e-300]])
    df = spark.createDataFrame([(float(v), "x") for v in values] + [(None, "x")], "v double, n string").repartition(7)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    expected = np.quantile(values, shares).tolist()
    assert ranks.quantiles(df, "v", shares) == pytest.approx(expected, rel=1e-12)
    assert retail.median(df, "v") == statistics.median(values.tolist())


def test_quantiles_of_few_values(spark):
    df = spark.createDataFrame([(1,), (4,), (None,), (2,), (2,)], "v int")
    assert ranks.quantiles(df, "v") == [2.0]
    assert ranks.quantiles(df.where("v <> 2"), "v") == [2.5]
    assert ranks.quantiles(df.where("v IS NULL"), "v", [0.5, 0.9]) == [None, None]
    nan = spark.createDataFrame([(1.0,), (math.nan,), (2.0,)], "v double")
    ends = spark.createDataFrame([(math.inf,), (-math.inf,), (3.0,)], "v double")
    assert ranks.quantiles(ends, "v", [0.0, 0.5, 1.0]) == [-math.inf, 3.0, math.inf]
    assert ranks.quantiles(nan, "v") == [2.0] and math.isnan(ranks.quantiles(nan, "v", [1.0])[0])
    with pytest.raises(IndexError):
        ranks.values_at(df.dropna(), "v", [4])


# --- Sample --------------------------------------------------------------------


def test_sample_is_the_same_in_any_partitioning(spark):
    df = spark.range(4000).select((F.col("id") % 3000).alias("a"), F.when(F.col("id") % 3 > 0, "t").alias("b"))
    draws = [sorted(map(repr, retail.sample_rows(df.repartition(n)).collect())) for n in (1, 5)]
    assert draws[0] == draws[1] and 300 < len(draws[0]) < 500
    assert draws[0] != sorted(map(repr, retail.sample_rows(df, seed=1).collect()))
    assert retail.sample_rows(df, 1.0).count() == 4000 and retail.sample_rows(df, 0.0).count() == 0


def test_sample_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(retail, "COPIES", 70)
    df = spark.range(2000).selectExpr("1 AS x", "CAST(NULL AS string) AS y")
    assert 100 < retail.sample_rows(df).count() < 320
    assert retail.sample_rows(df, 1.0).count() == 2000
    assert retail.sample_rows(df.limit(0)).count() == 0


def test_sample_does_not_write_its_input(spark, monkeypatch):
    written = []
    real = retail.stage
    monkeypatch.setattr(retail, "stage", lambda df, name: (written.append(df.columns), real(df, name))[1])
    retail.sample_rows(spark.range(100).withColumn("wide", F.lit("x")))
    assert written == [["__identity"]]


# --- Checks at load --------------------------------------------------------------


def test_metrics_are_taken_while_rows_are_written(spark):
    rows = [(1, None, 2, 3.0, 4, 12.0), (2, None, None, 1.0, 0, 5.0), (3, None, 2, None, 1, 1.0)]
    df = spark.createDataFrame(
        rows, "customer_id int, order_date date, product_id int, price double, quantity int, total_price double"
    )
    stored, seen = quality.load_checked(df, quality.line_metrics())
    asked = stored.agg(*quality.line_metrics()).first().asDict()
    assert seen == {k: None if v is None else float(v) for k, v in asked.items()}
    assert (seen["total_rows"], seen["null_order_date"], seen["invalid_rows"], seen["mismatch_count"]) == (3, 3, 1, 1)
    found = {r["check_name"]: r["value"] for r in quality.metric_rows(df, seen, "t").collect()}
    assert found == seen
    none = quality.load_checked(df.limit(0), quality.line_metrics())[1]
    assert none["total_rows"] == 0 and none["avg_price"] is None


def test_demand_model_round_trip(spark, tmp_path):
    rows = [(i, float(i % 13), "AB"[i % 2], i % 7, i % 13 + i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "row int, price double, payment_method string, dow int, quantity int")
    training = pricing.training_frame(df)
    model = pricing.fit_demand(training, trees=12, depth=3)
    assert 0 < len(model.trees.trees) <= 12
    pricing.save_model(spark, model, str(tmp_path / "m"))
    again = pricing.load_model(spark, str(tmp_path / "m"))
    scored = pricing.predict_demand(training, model).orderBy("row").collect()
    assert scored == pricing.predict_demand(training, again).orderBy("row").collect()
    assert "payment_method_code" not in scored[0].asDict()


# --- What the sample's query moves ---------------------------------------------


def test_sampled_features_are_joined_once(spark, sf_dir, monkeypatch):
    stored = []
    real = queries.stage
    monkeypatch.setattr(queries, "stage", lambda df, name: (stored.append(name), real(df, name))[1])
    queries.sample_10pct(spark, sf_dir)
    assert stored == ["lines", "stats", "features"]


def test_lines_are_moved_without_parts_of_their_date(spark):
    lines = spark.sql("""SELECT 1 AS customer_id, 2 AS product_id, DATE'2020-03-01' AS order_date, 3 AS quantity,
        1D AS price, 3D AS total_price, 4 AS review_score, ' a ' AS payment_method, 'c' AS city, 'F' AS gender, 30 AS age""")
    stats = retail.product_stats(lines)
    seen = []
    real = retail.product_features
    retail.product_features = lambda rows, s: (seen.append(rows.columns), real(rows, s))[1]
    try:
        row = retail.order_line_features(lines, stats).first()
    finally:
        retail.product_features = real
    assert "dow" not in seen[0] and "year" not in seen[0]
    assert (row["year"], row["month"], row["day"], row["dow"], row["payment_method"]) == (2020, 3, 1, 1, "A")


# --- Boosting in one stage -----------------------------------------------------


def _same_trees(one, other):
    assert one.curve == other.curve and len(one.trees) == len(other.trees) > 0
    for a, b in zip(one.trees, other.trees):
        for part in ("feature", "threshold", "left", "right", "value"):
            assert (getattr(a, part) == getattr(b, part)).all()


def test_rounds_are_one_stage_with_the_trees_of_jobs(spark, lines, monkeypatch):
    context = spark.sparkContext

    def fit(rounds):
        group = f"rounds-{rounds}-{len(found)}"
        context.setJobGroup(group, "")
        model = boosting.fit_boosted(lines, ["a", "b", "c"], "y", "val", rounds=rounds, depth=3)
        context.setLocalProperty("spark.jobGroup.id", None)
        return model, len(context.statusTracker().getJobIdsForGroup(group))

    found = []
    monkeypatch.setattr(boosting, "TASK_ROWS", 400)
    for rounds in (4, 24):
        found.append(fit(rounds))
    assert found[0][1] == found[1][1]
    monkeypatch.setattr(boosting, "HELD", 0)
    monkeypatch.setattr(boosting, "CHUNK", 100)
    found.append(fit(24))
    monkeypatch.setattr(boosting, "side_by_side", lambda *_: 0)
    found.append(fit(24))
    _same_trees(found[1][0], found[2][0])
    _same_trees(found[1][0], found[3][0])


def test_a_task_without_rows_takes_part(spark, monkeypatch):
    df = spark.range(40).selectExpr("id * 1D AS a", "id % 4 = 0 AS val", "id % 7 * 1D AS y")
    one = boosting.fit_boosted(df.coalesce(1), ["a"], "y", "val", rounds=3, least_leaf=2)
    monkeypatch.setattr(boosting, "TASK_ROWS", 1)
    _same_trees(one, boosting.fit_boosted(df.coalesce(1), ["a"], "y", "val", rounds=3, least_leaf=2))


@given(st.integers(1, 5), st.integers(0, 9999), st.integers(0, 9))
@settings(max_examples=40, deadline=None)
def test_leaves_by_masks_are_those_of_a_walk(depth, seed, missing):
    rng = np.random.default_rng(seed)
    thresholds = [np.sort(rng.normal(size=n)) for n in rng.integers(1, 64, 4)]

    def grow(level, rows):
        at = len(rows)
        rows.append((-1, 0.0, at, at, float(rng.normal())))
        if level < depth and (not level or rng.random() < 0.8):
            f = int(rng.integers(4))
            left, right = grow(level + 1, rows), grow(level + 1, rows)
            rows[at] = (f, float(rng.choice(thresholds[f])), left, right, 0.0)
        return at

    trees = []
    for _ in range(5):
        grow(0, rows := [])
        trees.append(boosting.Tree.of(rows, depth))
    model = boosting.BoostedTrees(("a", "b", "c", "d"), 0.25, 0.1, tuple(trees))
    x = rng.normal(size=(300, 4))
    x[:40] = [rng.choice(t, 40) for t in thresholds][0][:, None]
    x[:missing] = np.nan
    walked = np.full(len(x), 0.25)
    for tree in trees:
        walked = walked + 0.1 * tree(x)
    assert (model(x) == walked).all()


def test_wide_levels_and_deep_trees(spark, lines):
    """Over 64 nodes a level, and over 32 leaves a tree."""
    model = boosting.fit_boosted(lines, ["a", "b", "c"], "y", "val", rounds=2, rate=1.0, depth=9, least_leaf=1)
    assert max(len(t.value) for t in model.trees) > 200
    scored = lines.withColumn("p", model.predict())
    error = scored.where("val").select(F.avg((F.col("y") - F.col("p")) ** 2)).first()[0]
    assert error == pytest.approx(model.curve[len(model.trees) - 1], rel=1e-9)


def test_only_shared_folders_are_opened(spark):
    assert blocks._shared("file:///a/b", spark) == "/a/b" and blocks._shared("file:/a/b", spark) == "/a/b"
    assert blocks._shared("/a/b", spark) == "/a/b" and blocks._shared("hdfs://host/a", spark) is None
    assert blocks.side_by_side(spark, 1) == 1 and blocks.side_by_side(spark, 1000) == 4


def test_rows_are_held_in_few_bytes(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(4, 5000)), rng.integers(0, 50, 5000)
    codes = boosting._Codes([boosting.candidate_splits(v) for v in x])
    assert len(codes.groups) == 2
    batch = pa.RecordBatch.from_arrays([*map(pa.array, x), pa.array(y * 1.0), pa.array(y == 3)], names=list("abcdyv"))
    block = boosting._pack(codes, 0.0)(batch)
    # Two codes, label, fitted value, place and what is left.
    assert block.size() == 5000 * (2 * 2 + 4 + 8 + 1 + 4) and block.train == (y != 3).sum()
    monkeypatch.setattr(boosting, "HELD", 0)
    held = boosting._Held(iter([block]), lambda sums: sums)
    rows, left = held.summed(boosting._histograms(codes, 2.0**-20))
    assert rows.sum() == 4 * block.train and left.sum() == 4 * y[y != 3].sum() << 20
    kept = held.blocks[0]
    assert all(isinstance(a, np.memmap) for a in (*kept.codes, kept.label, kept.fitted, kept.at, kept.rest))
    assert kept.rest.dtype == np.int32 and kept.at.dtype == np.uint8
