"""The three chains: daily load, manual load after a raw merge, and the full run.

Tables live in one namespace per layer. Bronze and silver grow by rows with new links, told by
stores of the links they hold. Gold tables are replaced by published versions, so readers
always find whole ones. Each step is entered in a ledger, by which a run that was killed goes
on. Schemas are those of ``schemas.py``, which the writes enforce.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake import schemas
from demandlake.operators import forecast, gold, ingest, pricing, quality, retail, segment, series, silver
from demandlake.session import stage
from demandlake.sources import csv_files
from demandlake.sources.catalog import LoadAudit, ensure_namespace, load_table
from demandlake.sources.keystore import KeyStore
from demandlake.sources.ledger import Run, RunLedger
from demandlake.sources.publish import Publications

RAW_TABLE, BRONZE_TABLE, SILVER_TABLE, FACT_TABLE = "postings_raw", "it_jobs_raw", "it_jobs_clean", "fact_job_posting"

GOLD_SCHEMAS = {
    "dim_skill": schemas.DIM_SKILL,
    "dim_location": schemas.DIM_LOCATION,
    "dim_company": schemas.DIM_COMPANY,
    "dim_date": schemas.DIM_DATE,
    "dim_job_category": schemas.DIM_JOB_CATEGORY,
    "dim_work_mode": schemas.DIM_WORK_MODE,
}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with exactly the columns and types of ``schema`` (DDL); text columns that are
    missing are NULL, any other missing column is an error."""
    columns = []
    for field in T.StructType.fromDDL(schema).fields:
        if field.name in df.columns:
            columns.append(F.col(f"`{field.name}`").cast(field.dataType).alias(field.name))
        elif isinstance(field.dataType, T.StringType):
            columns.append(F.lit(None).cast("string").alias(field.name))
        else:
            raise ValueError(f"column {field.name} is missing")
    return df.select(*columns)


class Lake:
    """The namespaces of one lake: bronze, silver and gold.

    ``key_buckets`` is the number of buckets of a new key store.
    """

    def __init__(self, spark: SparkSession, prefix: str = "", key_buckets: int | None = None):
        self.spark = spark
        self.bronze, self.silver, self.gold = (f"{prefix}{n}" for n in ("bronze", "silver", "gold"))
        for name in (self.bronze, self.silver, self.gold):
            ensure_namespace(spark, name)
        self.raw = Publications(spark, self.bronze)
        self.marts = Publications(spark, self.gold)
        self.ledger = RunLedger(spark, f"{self.bronze}.run_ledger")
        self._key_buckets = key_buckets

    def table(self, layer: str, name: str) -> str:
        return f"{getattr(self, layer)}.{name}"

    def links(self, layer: str, name: str) -> KeyStore:
        """The store of the links that a table holds."""
        return KeyStore(self.spark, f"{self.table(layer, name)}_links", "job_link", self._key_buckets)


def _append_new(lake: Lake, rows: DataFrame, name: str, store: KeyStore) -> LoadAudit:
    """Append rows with new links, and their links to the store of the table's links; a load
    that is cut short in between is made up for by the next one's ``sync``."""
    delta = stage(rows, "delta")
    audit = load_table(delta, name)
    if audit.added:
        store.add(delta.select(store.key))
        store.compact()
    return audit


def load_bronze(lake: Lake, raw: DataFrame, order: Sequence[str] = ()) -> LoadAudit:
    name, store = lake.table("bronze", BRONZE_TABLE), lake.links("bronze", BRONZE_TABLE)
    if lake.spark.catalog.tableExists(name):
        store.sync(lake.spark.table(name))
    fresh = ingest.stamp_bronze(ingest.unseen_rows(raw, store, order))
    return _append_new(lake, conform(fresh, schemas.BRONZE), name, store)


def load_silver(lake: Lake) -> LoadAudit:
    name, store = lake.table("silver", SILVER_TABLE), lake.links("silver", SILVER_TABLE)
    if lake.spark.catalog.tableExists(name):
        store.sync(lake.spark.table(name))
    fresh = store.unseen(lake.spark.table(lake.table("bronze", BRONZE_TABLE)))
    return _append_new(lake, conform(silver.clean_postings(fresh), schemas.SILVER), name, store)


def build_gold(lake: Lake) -> list[LoadAudit]:
    """All dimensions and the fact by date, replaced together: a build that fails leaves
    readers the tables they had."""
    clean = lake.spark.table(lake.table("silver", SILVER_TABLE))
    frames = {name: conform(dim, GOLD_SCHEMAS[name]) for name, dim in gold.dimensions(clean).items()}
    frames[FACT_TABLE] = conform(gold.fact_job_posting(clean), schemas.FACT_JOB_POSTING)
    return lake.marts.publish(frames, {FACT_TABLE: ["date_id"]})


def refresh_gold(lake: Lake) -> list[LoadAudit]:
    """Dimensions replaced, and of the fact only the dates that silver has added to since.

    Dates are told by ``clean_time``: those of postings cleaned after all that the fact
    holds. The dimensions come first, so every key of the fact has its row at any time; a
    refresh that is cut short is done again whole by the next one. Without a published fact
    everything is built.
    """
    if FACT_TABLE not in lake.marts.current():
        return build_gold(lake)
    clean = lake.spark.table(lake.table("silver", SILVER_TABLE))
    stored = lake.marts.table(FACT_TABLE).agg(F.max("clean_time")).first()[0]
    added = clean if stored is None else clean.where(F.col("clean_time") > F.lit(stored))
    dates = stage(added.select("date_posted").distinct(), "touched-dates")
    if dates.isEmpty():
        return []
    audits = lake.marts.publish({
        name: conform(dim, GOLD_SCHEMAS[name]) for name, dim in gold.dimensions(clean).items()
    })
    touched = clean.join(dates, "date_posted", "left_semi").select(*clean.columns)
    fact = conform(gold.fact_job_posting(touched), schemas.FACT_JOB_POSTING)
    return [*audits, lake.marts.refresh_partitions(FACT_TABLE, fact)]


def _daily_steps(lake: Lake, run: Run, raw: DataFrame, order: Sequence[str]) -> list[LoadAudit]:
    return [
        *run.step("bronze", lambda: [load_bronze(lake, raw, order)]),
        *run.step("silver", lambda: [load_silver(lake)]),
        *run.step("gold", lambda: refresh_gold(lake)),
    ]


def run_daily(
    lake: Lake, raw: DataFrame, order: Sequence[str] = (), run: str | None = None
) -> list[LoadAudit]:
    """Bronze, silver and gold. ``run`` names the run: one that was killed goes on at the
    first step that is not done when it is started again under its name."""
    return _daily_steps(lake, lake.ledger.open("daily", run), raw, order)


def merge_crawl(lake: Lake, new: DataFrame) -> LoadAudit:
    """The merged crawl with ``new`` added, as the next version of it: a CSV table that
    readers and the next merge find by its name, and that no crash leaves half written."""
    if RAW_TABLE in lake.raw.current():
        merged = ingest.merge_raw(lake.raw.table(RAW_TABLE), new)
    else:
        merged = ingest.merge_raw(new.limit(0), new)
    [audit] = lake.raw.publish(
        {RAW_TABLE: merged.hint("rebalance")}, format="csv", options=csv_files.EXPORT
    )
    return audit


def run_manual(lake: Lake, *crawls: str, run: str | None = None) -> list[LoadAudit]:
    """Merge crawl files into the lake's merged crawl, oldest first, and load it all."""
    steps = lake.ledger.open("manual", run)
    audits = []
    for i, path in enumerate(crawls, start=1):
        audits += steps.step(
            f"merge {i}", lambda p=path: [merge_crawl(lake, csv_files.read_postings_csv(lake.spark, p))]
        )
    return [*audits, *_daily_steps(lake, steps, lake.raw.table(RAW_TABLE), ())]


def run_forecast(lake: Lake, weekly: bool = False) -> list[LoadAudit]:
    """Forecasts, model coefficients and accuracy of every category, as tables."""
    star = lake.marts.snapshot()
    counts = series.postings_by(
        star[FACT_TABLE], star["dim_date"], star["dim_job_category"], "day" if weekly else "month"
    )
    if weekly:
        points = series.weekly_interpolate(series.daily_series(counts))
        found = forecast.forecast_additive(points, refit=True, evaluate_from=6)
    else:
        found = forecast.forecast_additive(series.monthly_series(counts))
    rows = {
        "ml_forecast_jobs": conform(forecast.forecast_table(found.forecast), schemas.FORECAST),
        "ml_model_evaluation": conform(forecast.evaluation_table(found.evaluation), schemas.EVALUATION),
        "ml_forecast_models": found.models,
    }
    return lake.marts.publish(rows)


def run_retail(
    lake: Lake, lines: DataFrame, model_path: str, sample_path: str, prices_path: str,
    trees: int = pricing.TREES,
) -> list[LoadAudit]:
    """Features, the demand model, prices and customer segments; the sample and the prices
    are exported as CSV too."""
    lines, checks = quality.load_checked(lines, quality.line_metrics(), "lines")
    stats = stage(retail.product_stats(lines), "stats")
    features = stage(retail.order_line_features(lines, stats), "features")
    sample = stage(retail.sample_rows(features), "sample")
    csv_files.write_csv(sample, sample_path)
    model = pricing.fit_demand(stage(pricing.training_frame(features), "training"), trees)
    pricing.save_model(lake.spark, model, model_path)
    products = retail.product_features(retail.representative(retail.time_features(lines)), stats)
    products = products.withColumn("payment_method", F.upper(F.trim("payment_method")))
    grid = pricing.price_grid(pricing.training_frame(products))
    prices = pricing.best_price(pricing.predict_demand(grid, pricing.load_model(lake.spark, model_path)))
    customers = stage(retail.rfm(lines), "rfm")
    clusters = segment.segment_customers(customers, segment.fit_segments(customers))
    prices = stage(conform(prices, schemas.PRICE_RECOMMENDATION), "prices")
    csv_files.write_csv(prices, prices_path)
    return lake.marts.publish({
        "data_quality": quality.metric_rows(lines, checks, "ecommerce_clean"),
        "features_sample": sample,
        "price_recommendations": prices,
        "customer_cluster": conform(clusters, schemas.CUSTOMER_CLUSTER),
    })


def run_full(
    lake: Lake, raw: DataFrame, lines: DataFrame, export_path: str, order: Sequence[str] = (),
    trees: int = pricing.TREES, run: str | None = None,
) -> list[LoadAudit]:
    """The daily chain, the forecasts and the retail chain. The model, the sample and the
    prices go to folders below ``export_path``, new ones for each attempt."""
    steps = lake.ledger.open("full", run)
    audits = _daily_steps(lake, steps, raw, order)
    audits += steps.step("forecast", lambda: run_forecast(lake))
    base = f"{export_path}/{uuid.uuid4().hex}"
    return audits + steps.step(
        "retail", lambda: run_retail(lake, lines, f"{base}/model", f"{base}/sample", f"{base}/prices", trees)
    )
