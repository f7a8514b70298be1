"""Dashboard questions over the gold star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.operators.forecast import forecast_trend
from demandlake.operators.gold import star_join


def market_overview(
    fact: DataFrame, dim_category: DataFrame, dim_company: DataFrame
) -> DataFrame:
    """Active jobs in all, per industry, per category group and per category.

    A job has one category and one company, so distinct links are counted once
    per pair and every level is a sum of those counts.
    """
    pairs = fact.groupBy("category_id", "company_id").agg(
        F.count_distinct("job_link").alias("jobs")
    )
    named = star_join(pairs, {"dim_job_category": dim_category, "dim_company": dim_company})
    labels = [F.col("industry"), F.col("category_group"), F.col("category_name")]
    sets = [[], labels[:1], labels[1:2], labels[1:]]
    level = (
        F.when(F.grouping("industry") == 0, "industry")
        .when(F.grouping("category_name") == 0, "category")
        .when(F.grouping("category_group") == 0, "category_group")
        .otherwise("total")
    )
    return named.groupingSets(sets, *labels).agg(
        level.alias("level"), F.sum("jobs").alias("active_jobs")
    )


def geography(fact: DataFrame, dim_location: DataFrame) -> DataFrame:
    """Jobs and posting-by-skill rows per city."""
    counts = fact.groupBy("location_id").agg(
        F.count_distinct("job_link").alias("active_jobs"),
        F.sum("post_count").alias("skill_demand"),
    )
    named = star_join(counts, {"dim_location": dim_location})
    return named.select("region", "city", "country", "active_jobs", "skill_demand")


def history_vs_forecast(series: DataFrame) -> DataFrame:
    """Observed counts and the trend forecast of the coming month ends, one row per date."""
    history = series.select(
        "job_category", "ds", F.lit("history").alias("kind"), F.col("y").cast("double").alias("jobs")
    )
    ahead = forecast_trend(series).where("kind = 'future'")
    return history.unionByName(
        ahead.select("job_category", "ds", F.lit("forecast").alias("kind"), F.col("yhat").alias("jobs"))
    )
