"""Silver to the gold star: six dimensions and the posting-by-skill fact.

Surrogate keys are hashes of the natural keys, so the fact computes them itself
and is built without a join or a shuffle; ``star_join`` goes the other way and
looks the natural keys up.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.functions import rules
from demandlake.functions.keys import date_key, dimension_key, fact_key
from demandlake.operators.keyed import first_per_key

FACT_KEY = ("job_link", "skill_id", "location_id")


def _exploded_skills(silver: DataFrame) -> DataFrame:
    return silver.select(F.explode(F.transform("skills_required", F.upper)).alias("skill_name"))


def dim_skill(silver: DataFrame) -> DataFrame:
    names = _exploded_skills(silver).where(rules.filled(F.col("skill_name"))).distinct()
    return names.select(
        dimension_key(F.col("skill_name")).alias("skill_id"),
        "skill_name",
        rules.skill_group(F.col("skill_name")).alias("skill_group"),
    )


def dim_location(silver: DataFrame) -> DataFrame:
    city = F.col("city")
    names = silver.select(F.col("location").alias("city")).dropna().distinct()
    return names.select(
        dimension_key(city).alias("location_id"),
        city,
        rules.region(city).alias("region"),
        F.lit(rules.COUNTRY).alias("country"),
    )


def dim_company(silver: DataFrame) -> DataFrame:
    names = silver.select("company_name").dropna().distinct()
    return names.select(
        dimension_key(F.col("company_name")).alias("company_id"),
        "company_name",
        F.lit(None).cast("string").alias("industry"),
    )


def dim_date(silver: DataFrame) -> DataFrame:
    day = F.col("date_posted")
    days = silver.select("date_posted").dropna().distinct()
    return days.select(
        date_key(day).alias("date_id"),
        day,
        F.dayofmonth(day).alias("day"),
        F.month(day).alias("month"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.date_format(day, "EEEE").alias("day_of_week"),
    )


def dim_job_category(silver: DataFrame, case_insensitive: bool = False) -> DataFrame:
    name = F.col("category_name")
    names = (
        silver.select(rules.category_name(F.col("job_category")).alias("category_name"))
        .dropna()
        .distinct()
    )
    return names.select(
        dimension_key(name).alias("category_id"),
        name,
        rules.category_group(name, case_insensitive).alias("category_group"),
    )


def dim_work_mode(silver: DataFrame) -> DataFrame | None:
    """None when silver has no work mode."""
    if "work_mode" not in silver.columns:
        return None
    names = silver.select("work_mode").dropna().distinct()
    return names.select(dimension_key(F.col("work_mode")).alias("mode_id"), "work_mode")


DIMENSIONS: dict[str, Callable[[DataFrame], DataFrame | None]] = {
    "dim_skill": dim_skill,
    "dim_location": dim_location,
    "dim_company": dim_company,
    "dim_date": dim_date,
    "dim_job_category": dim_job_category,
    "dim_work_mode": dim_work_mode,
}


def dimensions(silver: DataFrame) -> dict[str, DataFrame]:
    built = {name: build(silver) for name, build in DIMENSIONS.items()}
    return {name: dim for name, dim in built.items() if dim is not None}


def fact_job_posting(silver: DataFrame, unique_links: bool = True) -> DataFrame:
    """One row per posting and skill; postings without skills have none.

    Silver holds a link once, so distinct skills within the posting already make
    the fact key unique. ``unique_links=False`` handles tables that do not keep
    that promise by one more shuffle on the key columns (not on their hash,
    which collides at very large row counts).
    """
    skill = F.col("skill_name")
    rows = silver.withColumn(
        "skill_name", F.explode(F.array_distinct(F.transform("skills_required", F.upper)))
    )
    if "work_mode" in silver.columns:
        mode_id = dimension_key(F.col("work_mode"))
    else:
        mode_id = F.lit(None).cast("bigint")
    keyed = rows.withColumns({
        "company_id": dimension_key(F.col("company_name")),
        "skill_id": F.when(rules.filled(skill), dimension_key(skill)),
        "location_id": dimension_key(F.col("location")),
        "category_id": dimension_key(rules.category_name(F.col("job_category"))),
        "mode_id": mode_id,
        "date_id": date_key(F.col("date_posted")),
    })
    if not unique_links:
        others = ["date_id", "job_title", "company_id", "category_id", "mode_id", "clean_time"]
        keyed = first_per_key(keyed, FACT_KEY, others)
    return keyed.select(
        fact_key(*(F.col(c) for c in FACT_KEY)).alias("fact_id"),
        "job_title",
        "company_id",
        "skill_id",
        "location_id",
        "category_id",
        "mode_id",
        "date_id",
        F.col("date_id").alias("snapshot_date"),
        "job_link",
        F.lit(1).alias("post_count"),
        "clean_time",
    )


# The key of each dimension, in the dimension and in the fact.
STAR_KEYS = {
    "dim_skill": "skill_id",
    "dim_location": "location_id",
    "dim_company": "company_id",
    "dim_date": "date_id",
    "dim_job_category": "category_id",
    "dim_work_mode": "mode_id",
}


def star_join(fact: DataFrame, dims: Mapping[str, DataFrame], how: str = "left") -> DataFrame:
    """Fact with the columns of the given dimensions.

    No broadcast is forced: the planner knows the stored size of a dimension and
    broadcasts it below its threshold, and shuffles with skew handling above.
    """
    joined = fact
    for name, dim in dims.items():
        joined = joined.join(dim, STAR_KEYS[name], how)
    return joined


def partition_counts(fact: DataFrame, column: str = "date_id") -> DataFrame:
    rows: Column = F.count(F.lit(1))
    return fact.groupBy(column).agg(rows.alias("row_count"))
