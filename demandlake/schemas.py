"""Explicit schemas of the stored tables, as DDL. Every column is nullable."""

from __future__ import annotations

from pyspark.sql import types as T


# A crawled file has only text columns; types come from later expressions.
RAW_COLUMNS = (
    "job_title", "company_name", "location", "skills_required", "date_posted",
    "job_link", "job_category", "work_mode", "crawl_date", "date_only",
)


def text_columns(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


BRONZE = (
    ", ".join(f"{c} string" for c in RAW_COLUMNS) + ", ingest_time timestamp, source string"
)
SILVER = (
    "job_title string, company_name string, location string, skills_required array<string>, "
    "date_posted date, job_link string, job_category string, work_mode string, "
    "crawl_date string, date_only string, ingest_time timestamp, source string, "
    "clean_time timestamp"
)
DIM_SKILL = ("skill_id bigint, skill_name string, skill_group string")
DIM_LOCATION = ("location_id bigint, city string, region string, country string")
DIM_COMPANY = ("company_id bigint, company_name string, industry string")
DIM_DATE = (
    "date_id int, date_posted date, day int, month int, quarter int, year int, "
    "month_name string, day_of_week string"
)
DIM_JOB_CATEGORY = ("category_id bigint, category_name string, category_group string")
DIM_WORK_MODE = ("mode_id bigint, work_mode string")
FACT_JOB_POSTING = (
    "fact_id bigint, job_title string, company_id bigint, skill_id bigint, "
    "location_id bigint, category_id bigint, mode_id bigint, date_id int, "
    "snapshot_date int, job_link string, post_count int, clean_time timestamp"
)
FORECAST = (
    "forecast_date timestamp, predicted_jobs double, lower_bound double, "
    "upper_bound double, job_category string, created_at timestamp"
)
EVALUATION = (
    "job_category string, MAE double, RMSE double, `MAPE(%)` double, R2_Score double, "
    "DataPoints bigint, evaluated_at timestamp"
)
CUSTOMER_CLUSTER = ("customer_id bigint, cluster int")
PRICE_RECOMMENDATION = ("product_id bigint, best_price double, estimated_revenue double")
