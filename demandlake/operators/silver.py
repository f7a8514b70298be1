"""Bronze to silver: typed, standardised, one row per link."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.functions import rules
from demandlake.operators.keyed import first_per_key, total_order

REQUIRED = ("job_title", "company_name", "location", "job_link")


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trimmed lower-case names, words joined by underscores."""
    return df.withColumnsRenamed({
        name: "_".join(name.strip().lower().split(" ")) for name in df.columns
    })


def standardise(raw: DataFrame) -> DataFrame:
    """Apply the column rules; one output row per input row.

    A posting that lists several places keeps the first one that is not blank.
    """
    return normalise_headers(raw).withColumns({
        "job_title": F.initcap(F.trim("job_title")),
        "company_name": F.upper(F.trim("company_name")),
        "location": rules.first_city(F.col("location")),
        "work_mode": rules.work_mode(F.col("work_mode")),
        "skills_required": rules.skills(F.col("skills_required")),
        "date_posted": F.col("date_posted").try_cast("date"),
    })


def complete(df: DataFrame) -> DataFrame:
    """Rows that have every required text and a date."""
    test = F.col("date_posted").isNotNull()
    for name in REQUIRED:
        test = test & rules.filled(F.col(name))
    return df.where(test)


def clean_postings(raw: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Silver rows of ``raw``; among rows of one link the first in ``order`` stays."""
    valid = complete(standardise(raw))
    kept = first_per_key(valid, ["job_link"], total_order(valid, order, ["job_link"]))
    return kept.withColumn("clean_time", F.current_timestamp())


def silver_delta(bronze: DataFrame, silver: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Silver rows for links that silver does not hold yet.

    The links are compared first, on one narrow column of each table; only rows with a new
    link are standardised and ranked.
    """
    fresh = normalise_headers(bronze).join(silver.select("job_link"), "job_link", "left_anti")
    return clean_postings(fresh, order).select(*fresh_columns(bronze), "clean_time")


def fresh_columns(bronze: DataFrame) -> list[str]:
    return normalise_headers(bronze).columns


def explode_locations(raw: DataFrame) -> DataFrame:
    """One row per listed place, with its position; blank places are dropped."""
    return raw.select(
        "*", F.posexplode(rules.cities(F.col("location"))).alias("position", "city")
    ).where(rules.filled(F.col("city")))
