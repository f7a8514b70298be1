"""Posting counts as time series per category.

Counting is done on the fact first; everything after works on one row per
category and period, a size set by the calendar and not by the postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlake.functions.dates import month_ends_after, sunday_on_or_after
from demandlake.operators.gold import star_join

TRAIN_SHARE = 0.8
MIN_POINTS = 3
PERIODS = 3


def postings_by(
    fact: DataFrame, dim_date: DataFrame, dim_category: DataFrame, grain: str = "month"
) -> DataFrame:
    """Postings per period and category, by ``month`` or ``day``.

    The fact is reduced to one row per key pair before the dimensions are joined.
    """
    counts = fact.groupBy("date_id", "category_id").agg(F.count("fact_id").alias("jobs"))
    named = star_join(
        counts, {"dim_date": dim_date, "dim_job_category": dim_category}, "inner"
    )
    category = F.col("category_name").alias("job_category")
    if grain == "month":
        period = [F.col("year"), F.col("month")]
    elif grain == "day":
        period = [F.col("date_posted").alias("ds")]
    else:
        raise ValueError(f"grain must be 'month' or 'day', not {grain!r}")
    return named.groupBy(*period, category).agg(F.sum("jobs").alias("total_jobs"))


def monthly_series(counts: DataFrame) -> DataFrame:
    """Monthly counts as (job_category, ds, y), dated on the first of the month."""
    day = F.make_date("year", "month", F.lit(1))
    return counts.select("job_category", day.alias("ds"), F.col("total_jobs").alias("y"))


def daily_series(counts: DataFrame) -> DataFrame:
    return counts.select("job_category", "ds", F.col("total_jobs").alias("y"))


def eligibility(
    series: DataFrame, group: str = "job_category", evaluate_from: int = MIN_POINTS
) -> DataFrame:
    """Number of points per group and what to do with it: skip, fit_all or evaluate."""
    n = F.col("n_points")
    plan = F.when(n < MIN_POINTS, "skip").when(n < evaluate_from, "fit_all").otherwise("evaluate")
    counts = series.groupBy(group).agg(F.count(F.lit(1)).alias("n_points"))
    return counts.withColumn("plan", plan)


def split_by_time(
    df: DataFrame, group: str = "job_category", ts: str = "ds", share: float = TRAIN_SHARE
) -> DataFrame:
    """Mark the first ``share`` of each group's points as training points."""
    whole = Window.partitionBy(group)
    return df.withColumns({
        "n_points": F.count(F.lit(1)).over(whole),
        "position": F.row_number().over(whole.orderBy(ts)),
    }).withColumn("is_train", F.col("position") <= F.floor(F.col("n_points") * F.lit(share)))


def weekly_interpolate(
    df: DataFrame, group: str = "job_category", ts: str = "ds", y: str = "y"
) -> DataFrame:
    """Values on a Sunday grid per group, straight lines between known Sundays.

    Only values that fall on a Sunday are known. Sundays before the first known
    one are dropped, those after the last one repeat it.
    """
    points = df.select(group, ts, F.col(y).cast("double").alias(y)).dropna(subset=[ts, y])
    bounds = points.groupBy(group).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    grid = bounds.select(
        group,
        F.explode(
            F.sequence(
                sunday_on_or_after(F.col("lo")),
                sunday_on_or_after(F.col("hi")),
                F.expr("interval 7 days"),
            )
        ).alias(ts),
    )
    sundays = points.where(F.dayofweek(ts) == 1)
    known = grid.join(sundays, [group, ts], "left").withColumn(
        "known_at", F.when(F.col(y).isNotNull(), F.col(ts))
    )
    order = Window.partitionBy(group).orderBy(ts)
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spanned = known.select(
        group,
        ts,
        F.last(y, ignorenulls=True).over(before).alias("y0"),
        F.last("known_at", ignorenulls=True).over(before).alias("t0"),
        F.first(y, ignorenulls=True).over(after).alias("y1"),
        F.first("known_at", ignorenulls=True).over(after).alias("t1"),
    )
    step = F.date_diff(ts, "t0") / F.nullif(F.date_diff("t1", "t0"), F.lit(0))
    line = F.col("y0") + (F.col("y1") - F.col("y0")) * step
    return spanned.where(F.col("y0").isNotNull()).select(
        group, ts, F.coalesce(line, F.col("y0")).alias(y)
    )


def future_frame(
    df: DataFrame, group: str = "job_category", ts: str = "ds", periods: int = PERIODS
) -> DataFrame:
    """History dates of each group and its next month ends."""
    last = df.groupBy(group).agg(F.max(ts).alias("last_ts"))
    future = last.select(group, F.explode(month_ends_after(F.col("last_ts"), periods)).alias(ts))
    return df.select(group, ts, F.lit("history").alias("kind")).unionByName(
        future.withColumn("kind", F.lit("future"))
    )


def forecast_metrics(
    pred: DataFrame, group: str = "job_category", y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """MAE, RMSE, MAPE and R² per group; points with y = 0 are left out of MAPE."""
    error = F.col(y) - F.col(yhat)
    n = F.count(error)
    total = F.var_pop(F.when(error.isNotNull(), F.col(y))) * n
    squared = F.sum(error * error)
    r2 = F.when(n >= 2, F.when(
        total > 0, 1 - squared / total
    ).otherwise(F.when(squared == 0, 1.0).otherwise(0.0)))
    return pred.groupBy(group).agg(
        F.avg(F.abs(error)).alias("MAE"),
        F.sqrt(F.avg(error * error)).alias("RMSE"),
        (F.avg(F.abs(error / F.nullif(F.col(y), F.lit(0)))) * 100).alias("MAPE(%)"),
        r2.alias("R2_Score"),
    )
