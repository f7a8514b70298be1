"""Registered queries of the operators outside ``llm``, each over whole tables.

The SQL of every key is in ``demandlake.oracles``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake import oracles, pipeline
from demandlake.functions import rules
from demandlake.operators import forecast, gold, ingest, pricing, quality, retail, segment, series, silver
from demandlake.plans import reports
from demandlake.session import scratch_path, stage
from demandlake.sources import adapters, catalog, csv_files
from demandlake.sources.keystore import KeyStore

Query = Callable[[SparkSession, str], DataFrame]

POSTING_COLUMNS = (
    "job_title", "company_name", "location", "skills_required", "date_posted", "job_link",
    "job_category", "work_mode",
)
# Doubles that two engines may sum in another order are compared to this many digits.
DIGITS = 6


# --- Inputs ----------------------------------------------------------------


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.postings_raw(spark, sf_dir)


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.clean_postings(_postings(spark, sf_dir), ["seq"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.ecommerce_clean(spark, sf_dir)


def _star(
    spark: SparkSession, sf_dir: str, *names: str
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The fact and the named dimensions, all without names, from silver written once.

    Dimensions are stored: joins then broadcast those of a known small size, and the wide
    fact stays where it is.
    """
    clean = stage(_silver(spark, sf_dir), "silver")
    dims = {
        name: stage(dim, name) for name, dim in gold.dimensions(clean).items() if not names or name in names
    }
    return gold.fact_job_posting(clean), dims


def _counts(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    fact, dims = _star(spark, sf_dir, "dim_date", "dim_job_category")
    return series.postings_by(fact, dims["dim_date"], dims["dim_job_category"], grain)


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.monthly_series(_counts(spark, sf_dir, "month"))


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.weekly_interpolate(series.daily_series(_counts(spark, sf_dir, "day")))


@contextmanager
def _links_of(df: DataFrame) -> Iterator[KeyStore]:
    """A store of the links of ``df``, dropped at the end."""
    store = KeyStore(df.sparkSession, f"links_{uuid.uuid4().hex}", "job_link")
    try:
        store.add(df.select("job_link").where(F.col("job_link").isNotNull()).distinct())
        yield store
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {store.table}")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), DIGITS) for c in columns})


# --- Ingest ----------------------------------------------------------------


def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "postings-csv")
    csv_files.write_csv(_postings(spark, sf_dir).select(*POSTING_COLUMNS), path)
    return csv_files.read_postings_csv(spark, path, POSTING_COLUMNS, csv_files.NULL_MARKER)


def raw_merge(spark, sf_dir):
    postings = _postings(spark, sf_dir)
    return ingest.merge_raw(
        adapters.earlier_crawl(postings), adapters.later_crawl(postings), order=["seq"]
    ).select("seq", *POSTING_COLUMNS)


def bronze_append(spark, sf_dir):
    """New links of the whole crawl, beside a store of the earlier crawl's links."""
    postings = stage(_postings(spark, sf_dir), "postings")
    with _links_of(adapters.earlier_crawl(postings)) as store:
        return stage(ingest.stamp_bronze(ingest.unseen_rows(postings, store, ["seq"])), "bronze-delta").drop("ingest_time")


def load_audit(spark, sf_dir):
    """A first load, an append of everything, and the same append again."""
    postings = stage(_postings(spark, sf_dir), "postings")
    name = f"bronze_{uuid.uuid4().hex}"
    try:
        audits = [catalog.load_table(ingest.stamp_bronze(
            ingest.new_rows(adapters.earlier_crawl(postings), postings.limit(0), order=["seq"])
        ), name)]
        for _ in range(2):
            audits.append(catalog.load_table(ingest.bronze_delta(postings, spark.table(name), ["seq"]), name))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    steps = [("bronze", i, a.added, a.total) for i, a in enumerate(audits, start=1)]
    return spark.createDataFrame(steps, "table_name string, step int, added bigint, total bigint")


# --- Silver ----------------------------------------------------------------


def _silver_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "seq", "job_title", "company_name", "location",
        F.array_join("skills_required", "|").alias("skills"),
        "date_posted", "job_link", "job_category", "work_mode",
    )


def silver_clean(spark, sf_dir):
    return _silver_columns(_silver(spark, sf_dir))


def silver_incremental(spark, sf_dir):
    """Silver rows of the whole crawl that silver of the earlier crawl lacks."""
    postings = stage(_postings(spark, sf_dir), "postings")
    with _links_of(silver.clean_postings(adapters.earlier_crawl(postings), ["seq"])) as store:
        fresh = stage(store.unseen(silver.normalise_headers(postings)), "fresh")
    return _silver_columns(silver.clean_postings(fresh, ["seq"]))


def work_mode_norm(spark, sf_dir):
    raw = F.col("work_mode")
    return _postings(spark, sf_dir).groupBy(
        raw.alias("raw_mode"), rules.work_mode(raw).alias("work_mode")
    ).agg(F.count(F.lit(1)).alias("cnt"))


def location_norm(spark, sf_dir):
    raw = F.col("location")
    return _postings(spark, sf_dir).groupBy(
        raw.alias("raw_location"), rules.first_city(raw).alias("city")
    ).agg(F.count(F.lit(1)).alias("cnt"))


def location_explode(spark, sf_dir):
    return silver.explode_locations(_postings(spark, sf_dir)).select("seq", "position", "city")


def skills_array(spark, sf_dir):
    return _postings(spark, sf_dir).select(
        "seq", F.array_join(rules.skills(F.col("skills_required")), "|").alias("skills"),
        F.size(rules.skills(F.col("skills_required"))).alias("n_skills"),
    )


# --- Gold ------------------------------------------------------------------


def _dimension(name: str, key: str) -> Query:
    def query(spark, sf_dir):
        dim = gold.DIMENSIONS[name](_silver(spark, sf_dir))
        return dim if key == "date_id" else dim.drop(key)

    return query


def fact_job_posting(spark, sf_dir):
    """The fact with the natural keys that its hashed keys stand for."""
    fact, dims = _star(spark, sf_dir)
    return gold.star_join(fact, dims).select(
        "job_link", "job_title", "skill_name", "city", "company_name", "category_name",
        "work_mode", "date_id", "snapshot_date", "date_posted", "post_count",
    )


def fact_partition_counts(spark, sf_dir):
    clean = stage(_silver(spark, sf_dir), "silver")
    return gold.partition_counts(gold.fact_job_posting(clean))


@contextmanager
def _scratch_lake(spark: SparkSession) -> Iterator[pipeline.Lake]:
    lake = pipeline.Lake(spark, f"q{uuid.uuid4().hex}_")
    try:
        yield lake
    finally:
        for name in (lake.bronze, lake.silver, lake.gold):
            spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def gold_refresh(spark, sf_dir):
    """Rows by date of the published fact, built of the earlier crawl and then refreshed, date
    by date, with what the whole crawl adds."""
    postings = stage(_postings(spark, sf_dir), "postings")
    with _scratch_lake(spark) as lake:
        pipeline.run_daily(lake, adapters.earlier_crawl(postings), ["seq"])
        pipeline.run_daily(lake, postings, ["seq"])
        return stage(gold.partition_counts(lake.marts.table(pipeline.FACT_TABLE)), "partition-counts")


# --- Quality ---------------------------------------------------------------


def dq_totals(spark, sf_dir):
    return quality.total_rows(_lines(spark, sf_dir))


def dq_nulls(spark, sf_dir):
    return quality.null_profile(_lines(spark, sf_dir), quality.LINE_COLUMNS)


def dq_fact_null_fks(spark, sf_dir):
    star = adapters.sales_star(_lines(spark, sf_dir))
    return quality.null_profile(star["fact_sales"], quality.FACT_KEYS)


def dq_nonpositive(spark, sf_dir):
    return quality.nonpositive(_lines(spark, sf_dir), ["quantity", "price", "total_price"])


def dq_text_format(spark, sf_dir):
    return quality.text_drift(_lines(spark, sf_dir), "category_name")


def dq_total_mismatch(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    fact = adapters.sales_star(lines)["fact_sales"]
    return quality.total_mismatch(lines, "total_price", "quantity", "price").withColumn(
        "table_name", F.lit("ecommerce_clean")
    ).unionByName(
        quality.total_mismatch(fact, "totalamount", "quantity", "price").withColumn(
            "table_name", F.lit("fact_sales")
        )
    )


def dq_distinct_keys(spark, sf_dir):
    star = adapters.sales_star(_lines(spark, sf_dir))
    customers = quality.distinct_keys(star["dim_customer"], "customerid", "unique_customers")
    products = quality.distinct_keys(star["dim_product"], "productid", "unique_products")
    return customers.crossJoin(F.broadcast(products))  # one row each


def dq_value_freq(spark, sf_dir):
    return quality.value_freq(_lines(spark, sf_dir), "payment_method")


def dq_averages(spark, sf_dir):
    return quality.averages(_lines(spark, sf_dir), ["price", "quantity", "total_price"])


def dq_date_span(spark, sf_dir):
    return quality.date_span(_lines(spark, sf_dir), "order_date")


def dq_revenue(spark, sf_dir):
    return quality.revenue(_lines(spark, sf_dir), "total_price")


def dq_preview(spark, sf_dir):
    return quality.preview(adapters.sales_star(_lines(spark, sf_dir))["dim_customer"], "customerid")


def dq_schema(spark, sf_dir):
    return catalog.describe_tables({"ecommerce_clean": _lines(spark, sf_dir)})


def dq_suite(spark, sf_dir):
    lines, observed = quality.load_checked(_lines(spark, sf_dir), quality.line_metrics(), "lines")
    return quality.dq_suite(lines, adapters.sales_star(lines), observed)


# --- Series ----------------------------------------------------------------


def postings_monthly(spark, sf_dir):
    return _counts(spark, sf_dir, "month").orderBy("year", "month", "job_category")


def postings_daily(spark, sf_dir):
    return _counts(spark, sf_dir, "day").orderBy("ds", "job_category")


def series_eligibility(spark, sf_dir):
    return series.eligibility(_monthly(spark, sf_dir), evaluate_from=6)


def train_test_split_time(spark, sf_dir):
    return series.split_by_time(_monthly(spark, sf_dir))


def weekly_interpolate(spark, sf_dir):
    return _rounded(_weekly(spark, sf_dir), "y")


def future_frame(spark, sf_dir):
    return series.future_frame(_monthly(spark, sf_dir))


def forecast_trend(spark, sf_dir):
    fitted = forecast.forecast_trend(stage(_monthly(spark, sf_dir), "monthly"))
    return _rounded(fitted, "yhat", "yhat_lower", "yhat_upper")


def forecast_metrics(spark, sf_dir):
    """How well the straight line of the first 80 % of months meets the rest."""
    split = stage(series.split_by_time(_monthly(spark, sf_dir)), "split")
    models = forecast.trend_models(split.where("is_train"), "job_category", "ds", "y")
    scored = split.where("NOT is_train").join(models, "job_category").withColumn(
        "yhat", F.col("a") + F.col("b") * F.unix_date("ds")
    )
    metrics = series.forecast_metrics(scored).withColumnRenamed("MAPE(%)", "MAPE")
    return _rounded(metrics, "MAE", "RMSE", "MAPE", "R2_Score")


def forecast_monthly(spark, sf_dir):
    found = forecast.forecast_additive(_monthly(spark, sf_dir))
    return forecast.forecast_table(found.forecast).drop("created_at")


def forecast_weekly(spark, sf_dir):
    found = forecast.forecast_additive(_weekly(spark, sf_dir), refit=True, evaluate_from=6)
    return forecast.forecast_table(found.forecast).drop("created_at")


# --- Retail ----------------------------------------------------------------


def time_features(spark, sf_dir):
    return retail.time_features(_lines(spark, sf_dir)).groupBy("year", "month", "day", "dow").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("quantity").alias("quantity")
    )


def product_stats(spark, sf_dir):
    return retail.product_stats(_lines(spark, sf_dir))


def _features(spark, sf_dir) -> DataFrame:
    lines = stage(_lines(spark, sf_dir), "lines")
    return retail.order_line_features(lines, stage(retail.product_stats(lines), "stats"))


def product_features(spark, sf_dir):
    lines = stage(_lines(spark, sf_dir), "lines")
    stats = stage(retail.product_stats(lines), "stats")
    return retail.product_features(lines, stats).select(
        "customer_id", "product_id", "order_date", "quantity", "total_price",
        "prod_total_qty", "prod_avg_price", "prod_unique_buyers",
    )


def order_line_features(spark, sf_dir):
    return _features(spark, sf_dir)


def customer_rfm_days(spark, sf_dir):
    return retail.customer_rfm_days(_lines(spark, sf_dir))


def rfm(spark, sf_dir):
    return retail.rfm(_lines(spark, sf_dir))


def rfm_scaled(spark, sf_dir):
    scaled = segment.rfm_scaled(retail.rfm(_lines(spark, sf_dir)))
    return _rounded(scaled, "recency_z", "frequency_z", "monetary_z")


def impute_median(spark, sf_dir):
    lines = stage(_lines(spark, sf_dir), "lines")
    return retail.impute(lines).select(
        "customer_id", "product_id", "order_date", "payment_method", "review_score", "age"
    )


def category_codes(spark, sf_dir):
    return pricing.category_codes(_lines(spark, sf_dir))


def product_representative(spark, sf_dir):
    return retail.representative(_lines(spark, sf_dir))


def _representatives(lines: DataFrame) -> DataFrame:
    stats = stage(retail.product_stats(lines), "stats")
    rows = retail.product_features(retail.representative(retail.time_features(lines)), stats)
    return rows.withColumn("payment_method", F.upper(F.trim("payment_method")))


def price_grid(spark, sf_dir):
    lines = stage(_lines(spark, sf_dir), "lines")
    return pricing.price_grid(_representatives(lines)).select(
        "product_id", "grid_index", "base_price", "price"
    )


def price_best(spark, sf_dir):
    curves = pricing.demand_curves(_lines(spark, sf_dir))
    best = pricing.best_price_closed(curves)
    return best.withColumns({c: F.round(c, 4) for c in ("best_price", "estimated_revenue")})


def sample_10pct(spark, sf_dir):
    # Written once: the sample reads its rows three times, and the join that makes them
    # shuffles whole lines where the products are many.
    return retail.sample_rows(stage(_features(spark, sf_dir), "features"))


def _demand(features: DataFrame):
    training = stage(pricing.training_frame(features), "training")
    return training, pricing.fit_demand(training)


def demand_predict(spark, sf_dir):
    training, model = _demand(_features(spark, sf_dir))
    return pricing.predict_demand(training, model).select(
        "customer_id", "product_id", "order_date", "quantity", "predicted_quantity"
    )


def price_recommend(spark, sf_dir):
    lines = stage(_lines(spark, sf_dir), "lines")
    features = retail.order_line_features(lines, stage(retail.product_stats(lines), "stats"))
    _, model = _demand(features)
    grid = pricing.price_grid(pricing.training_frame(_representatives(lines)))
    return pricing.best_price(pricing.predict_demand(grid, model))


def customer_clusters(spark, sf_dir):
    table = stage(retail.rfm(_lines(spark, sf_dir)), "rfm")
    return segment.segment_customers(table, segment.fit_segments(table))


# --- Reports ---------------------------------------------------------------


def report_market_overview(spark, sf_dir):
    fact, dims = _star(spark, sf_dir, "dim_job_category", "dim_company")
    return reports.market_overview(fact, dims["dim_job_category"], dims["dim_company"])


def report_geography(spark, sf_dir):
    fact, dims = _star(spark, sf_dir, "dim_location")
    return reports.geography(fact, dims["dim_location"])


def report_history_vs_forecast(spark, sf_dir):
    return _rounded(reports.history_vs_forecast(stage(_monthly(spark, sf_dir), "monthly")), "jobs")


QUERIES: tuple[Query, ...] = (
    csv_roundtrip, raw_merge, bronze_append, load_audit,
    silver_clean, silver_incremental, work_mode_norm, location_norm, location_explode, skills_array,
    fact_job_posting, fact_partition_counts, gold_refresh,
    dq_totals, dq_nulls, dq_fact_null_fks, dq_nonpositive, dq_text_format, dq_total_mismatch,
    dq_distinct_keys, dq_value_freq, dq_averages, dq_date_span, dq_revenue, dq_preview, dq_schema,
    dq_suite,
    postings_monthly, postings_daily, series_eligibility, train_test_split_time,
    weekly_interpolate, future_frame, forecast_trend, forecast_metrics, forecast_monthly,
    forecast_weekly,
    time_features, product_stats, product_features, order_line_features, customer_rfm_days, rfm,
    rfm_scaled, impute_median, category_codes, product_representative, price_grid, price_best,
    sample_10pct, demand_predict, price_recommend, customer_clusters,
    report_market_overview, report_geography, report_history_vs_forecast,
)


def queries() -> dict[str, Query]:
    found = {query.__name__: query for query in QUERIES}
    return found | {name: _dimension(name, key) for name, key in gold.STAR_KEYS.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
