"""Demand forecasts per category.

``forecast_trend`` is a straight line, all in SQL aggregates. The additive model
(piecewise-linear trend plus yearly waves, after Taylor & Letham, "Forecasting
at Scale", 2018) is fitted per group in pandas on executors; its coefficients
are an ordinary table, and predictions from them are Catalyst expressions.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.functions.numeric import intercept, slope
from demandlake.operators import series as ts_ops
from demandlake.session import stage

Z80 = 1.2815515655446004  # 80 % two-sided normal interval


# --- Straight line ---------------------------------------------------------


def trend_models(df: DataFrame, group: str, ts: str, y: str) -> DataFrame:
    """Least-squares line per group over days since 1970, from exact sums."""
    x, v = F.unix_date(ts).cast("bigint"), F.col(y)
    sums = df.where(v.isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(x).cast("double").alias("sx"),
        F.sum(v).cast("double").alias("sy"),
        F.sum(x * x).cast("double").alias("sxx"),
        F.sum(x * v).cast("double").alias("sxy"),
        F.sum(v * v).cast("double").alias("syy"),
    )
    c = {name: F.col(name) for name in sums.columns[1:]}
    line = sums.withColumn(
        "b", F.coalesce(slope(c["n"], c["sx"], c["sy"], c["sxx"], c["sxy"]), F.lit(0.0))
    ).withColumn("a", intercept(c["n"], c["sx"], c["sy"], F.col("b")))
    spread = (c["n"] * c["syy"] - c["sy"] * c["sy"]) - F.col("b") * (
        c["n"] * c["sxy"] - c["sx"] * c["sy"]
    )
    noise = F.sqrt(F.greatest(spread, F.lit(0.0))) / c["n"]
    return line.select(group, "a", "b", noise.alias("noise"))


def forecast_trend(
    df: DataFrame,
    group: str = "job_category",
    ts: str = "ds",
    y: str = "y",
    periods: int = ts_ops.PERIODS,
) -> DataFrame:
    """Fitted history and the next month ends on a straight line, with an 80 % band."""
    frame = ts_ops.future_frame(df, group, ts, periods)
    scored = frame.join(trend_models(df, group, ts, y), group)
    yhat = F.col("a") + F.col("b") * F.unix_date(ts)
    return scored.select(
        group, ts, "kind",
        yhat.alias("yhat"),
        (yhat - Z80 * F.col("noise")).alias("yhat_lower"),
        (yhat + Z80 * F.col("noise")).alias("yhat_upper"),
    )


# --- Additive model --------------------------------------------------------

HARMONICS = 10
YEAR_DAYS = 365.25
CHANGEPOINTS = 25
CHANGEPOINT_SHARE = 0.8
# Prior standard deviations, on data scaled to at most 1.
LEVEL_SD, BEND_SD, WAVE_SD = 5.0, 0.05, 10.0
NOISE_FLOOR = 0.01
ROUNDS = 8

MODEL_FIELDS = (
    "origin date, span_days int, base double, growth double, knots array<double>, "
    "bends array<double>, waves array<double>, noise double, drift double, fit_points bigint"
)


def fit_additive(df: DataFrame, group: str = "job_category", ts: str = "ds", y: str = "y") -> DataFrame:
    """One row of coefficients per group. A group is one calendar-bounded series."""
    spark = df.sparkSession
    field = df.schema[group].dataType.simpleString()

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{group: key[0], **_fit_series(pdf[ts], pdf[y])}])

    # A set number of partitions keeps adaptive execution from merging the tiny
    # groups into one task: the fits are small in bytes, not in CPU time.
    spread = df.select(group, ts, y).repartition(spark.sparkContext.defaultParallelism, group)
    return spread.groupBy(group).applyInPandas(fit, f"{group} {field}, {MODEL_FIELDS}")


def _fit_series(ts: pd.Series, y: pd.Series) -> dict:
    days = pd.to_datetime(ts).to_numpy().astype("datetime64[D]").astype(np.int64)
    order = np.argsort(days, kind="stable")
    days, values = days[order], y.to_numpy(dtype=float)[order]
    span = max(int(days[-1] - days[0]), 1)
    t = (days - days[0]) / span
    scale = float(np.abs(values).max()) or 1.0

    early = max(int(len(t) * CHANGEPOINT_SHARE), 1)
    count = min(CHANGEPOINTS, early - 1)
    knots = t[np.linspace(0, early - 1, count + 1).round().astype(int)][1:]
    hinges = np.maximum(t[:, None] - knots[None, :], 0.0)
    phase = 2 * np.pi * (days / YEAR_DAYS)[:, None] * np.arange(1, HARMONICS + 1)[None, :]
    waves = np.stack([np.sin(phase), np.cos(phase)], axis=2).reshape(len(t), -1)
    design = np.column_stack([np.ones_like(t), t, hinges, waves])
    prior = np.concatenate([
        np.full(2, LEVEL_SD), np.full(count, BEND_SD), np.full(2 * HARMONICS, WAVE_SD),
    ])

    target = values / scale
    noise, beta = 0.5, np.zeros(design.shape[1])
    for _ in range(ROUNDS):
        gram = design.T @ design + np.diag((noise / prior) ** 2)
        beta = np.linalg.solve(gram, design.T @ target)
        noise = max(float(np.sqrt(np.mean((target - design @ beta) ** 2))), NOISE_FLOOR)

    bends = beta[2:2 + count]
    # Variance of a trend that keeps bending at the past rate grows with h³/3.
    drift = 2 * float(np.mean(np.abs(bends))) ** 2 * count if count else 0.0
    return {
        "origin": (np.datetime64("1970-01-01") + days[0]).astype(object),
        "span_days": span,
        "base": scale * beta[0],
        "growth": scale * beta[1],
        "knots": knots.tolist(),
        "bends": (scale * bends).tolist(),
        "waves": (scale * beta[2 + count:]).tolist(),
        "noise": scale * noise,
        "drift": scale * scale * drift,
        "fit_points": len(t),
    }


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def predict_additive(
    frame: DataFrame, models: DataFrame, group: str = "job_category", ts: str = "ds"
) -> DataFrame:
    """``frame`` with yhat and its 80 % band from stored coefficients."""
    t = F.date_diff(ts, "origin") / F.col("span_days")
    bends = F.zip_with("knots", "bends", lambda s, d: d * F.greatest(t - s, F.lit(0.0)))
    turn = F.unix_date(ts) * F.lit(2 * math.pi / YEAR_DAYS)
    # Coefficients alternate: sine and cosine of each harmonic.
    waves = F.transform(
        "waves",
        lambda w, i: w * F.when(i % 2 == 0, F.sin(turn * (F.floor(i / 2) + 1))).otherwise(
            F.cos(turn * (F.floor(i / 2) + 1))
        ),
    )
    yhat = F.col("base") + F.col("growth") * t + _total(bends) + _total(waves)
    ahead = F.greatest(t - 1, F.lit(0.0))
    half = Z80 * F.sqrt(F.col("noise") * F.col("noise") + F.col("drift") * F.pow(ahead, F.lit(3)) / 3)
    scored = frame.join(models, group).withColumn("yhat", yhat).withColumn("__half", half)
    return scored.select(
        *[c for c in frame.columns],
        "yhat",
        (F.col("yhat") - F.col("__half")).alias("yhat_lower"),
        (F.col("yhat") + F.col("__half")).alias("yhat_upper"),
    )


class Forecast(NamedTuple):
    models: DataFrame
    forecast: DataFrame
    evaluation: DataFrame


def forecast_additive(
    df: DataFrame,
    group: str = "job_category",
    ts: str = "ds",
    y: str = "y",
    periods: int = ts_ops.PERIODS,
    refit: bool = False,
    evaluate_from: int = ts_ops.MIN_POINTS,
) -> Forecast:
    """Fit on the first 80 %, evaluate on the rest, predict history and future.

    Groups below three points are skipped. With ``refit`` the published model is
    fitted on all points and groups below ``evaluate_from`` get NULL metrics;
    without, the future starts where the training part ends.
    """
    split = ts_ops.split_by_time(df, group, ts)
    points = stage(split.where(F.col("n_points") >= ts_ops.MIN_POINTS), "series")
    evaluated = points.where(F.col("n_points") >= evaluate_from)
    train = evaluated.where("is_train")
    test = evaluated.where("NOT is_train").select(group, ts, y)

    eval_models = stage(fit_additive(train, group, ts, y), "models")
    models = stage(fit_additive(points, group, ts, y), "models") if refit else eval_models

    history = points if refit else train
    frame = ts_ops.future_frame(history, group, ts, periods)
    forecast = predict_additive(frame, models, group, ts)

    metrics = ts_ops.forecast_metrics(predict_additive(test, eval_models, group, ts), group, y)
    sizes = points.groupBy(group).agg(F.count(F.lit(1)).alias("DataPoints"))
    return Forecast(models, forecast, metrics.join(sizes, group, "right"))


def forecast_table(forecast: DataFrame, group: str = "job_category", ts: str = "ds") -> DataFrame:
    """Forecast rows in their published form."""
    return forecast.select(
        F.col(ts).cast("timestamp").alias("forecast_date"),
        F.col("yhat").alias("predicted_jobs"),
        F.col("yhat_lower").alias("lower_bound"),
        F.col("yhat_upper").alias("upper_bound"),
        group,
        F.current_timestamp().alias("created_at"),
    )


def evaluation_table(evaluation: DataFrame, group: str = "job_category") -> DataFrame:
    """Metrics in their published form, rounded."""
    return evaluation.select(
        group,
        F.round("MAE", 2).alias("MAE"),
        F.round("RMSE", 2).alias("RMSE"),
        F.round(F.col("`MAPE(%)`"), 2).alias("MAPE(%)"),
        F.round("R2_Score", 3).alias("R2_Score"),
        "DataPoints",
        F.current_timestamp().alias("evaluated_at"),
    )
