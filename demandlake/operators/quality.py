"""Data-quality checks. Each check is one pass of partial aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from demandlake.functions.numeric import MONEY, money_avg
from demandlake.session import stage

TOLERANCE = 0.01
PREVIEW = 10

# The columns and keys that the checks count.
LINE_COLUMNS = ("customer_id", "order_date", "product_id", "price", "quantity", "total_price")
FACT_KEYS = {
    "customer": "customerkey",
    "product": "productkey",
    "category": "categorykey",
    "city": "citykey",
    "payment": "paymentkey",
    "date": "datekey",
}


def off_total(total: str, quantity: str, price: str, tolerance: float = TOLERANCE) -> Column:
    return F.abs(F.col(total) - F.col(quantity) * F.col(price)) > tolerance


def not_positive(*columns: str) -> Column:
    test = F.lit(False)
    for name in columns:
        test = test | (F.col(name) <= 0)
    return test


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def null_profile(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """NULLs per column, named ``null_<label>``."""
    named = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{n}") for n, c in named.items()])


def nonpositive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(not_positive(*columns)).agg(F.count(F.lit(1)).alias("invalid_rows"))


def text_drift(df: DataFrame, column: str, limit: int = PREVIEW) -> DataFrame:
    """Values that are not trimmed upper case, in order, as a preview."""
    text = F.col(column)
    return (
        df.select(column).where(text != F.upper(F.trim(text))).distinct().orderBy(column).limit(limit)
    )


def total_mismatch(
    df: DataFrame, total: str, quantity: str, price: str, tolerance: float = TOLERANCE
) -> DataFrame:
    rows = df.where(off_total(total, quantity, price, tolerance))
    return rows.agg(F.count(F.lit(1)).alias("mismatch_count"))


def distinct_keys(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias(name))


def value_freq(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), column)


def averages(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    return df.agg(*[F.round(money_avg(F.col(c)), digits).alias(f"avg_{c}") for c in columns])


def date_span(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("start_date"), F.max(column).alias("end_date"))


def revenue(df: DataFrame, column: str) -> DataFrame:
    total = F.sum(F.col(column).cast(MONEY))
    return df.agg(F.round(total, 2).cast("double").alias("total_revenue"))


def preview(df: DataFrame, key: str, limit: int = PREVIEW) -> DataFrame:
    return df.orderBy(key).limit(limit)


def _long(checks: DataFrame, table: str) -> DataFrame:
    """One row of named counters as (check, table_name, value) rows."""
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("check_name"),
            F.lit(table).alias("table_name"),
            F.col(c).cast("double").alias("value"),
        )
        for c in checks.columns
    ])
    return checks.select(F.inline(rows))


def line_metrics() -> list[Column]:
    """The counters and averages of order lines, all of them sums that a pass can carry."""
    return [
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in LINE_COLUMNS],
        F.count_if(not_positive("quantity", "price", "total_price")).alias("invalid_rows"),
        F.count_if(off_total("total_price", "quantity", "price")).alias("mismatch_count"),
        *[
            F.round(money_avg(F.col(c)), 2).alias(f"avg_{c}")
            for c in ("price", "quantity", "total_price")
        ],
    ]


def load_checked(
    df: DataFrame, metrics: Sequence[Column], name: str = "checked"
) -> tuple[DataFrame, dict[str, float | None]]:
    """Write ``df`` once and take the named metrics from the rows as they are written, at no
    scan of their own."""
    seen = Observation()
    stored = stage(df.observe(seen, *metrics), name)
    return stored, {k: None if v is None else float(v) for k, v in seen.get.items()}


def metric_rows(like: DataFrame, metrics: Mapping[str, float | None], table: str) -> DataFrame:
    """Metrics taken before as (check, table_name, value) rows."""
    rows = [(k, table, v) for k, v in metrics.items()]
    return like.sparkSession.createDataFrame(rows, "check_name string, table_name string, value double")


def dq_suite(
    lines: DataFrame, star: Mapping[str, DataFrame], observed: Mapping[str, float | None] | None = None
) -> DataFrame:
    """Every check as (check_name, table_name, value).

    The line metrics are those ``observed`` when the lines were written, and cost a scan only
    without them. All counters of a table share one scan; only the value frequencies and the
    dimension key counts need their own grouping.
    """
    count = F.count(F.lit(1))
    if observed is None:
        line_checks = _long(lines.agg(*line_metrics()), "ecommerce_clean")
    else:
        line_checks = metric_rows(lines, observed, "ecommerce_clean")
    category = F.col("category_name")
    drift = (
        lines.select(category)
        .where(category != F.upper(F.trim(category)))
        .agg(F.count_distinct(category).alias("drifted_categories"))
    )
    freq = lines.groupBy("payment_method").agg(count.alias("value")).select(
        F.concat(F.lit("payment_method="), F.coalesce("payment_method", F.lit("NULL"))).alias(
            "check_name"
        ),
        F.lit("ecommerce_clean").alias("table_name"),
        F.col("value").cast("double").alias("value"),
    )
    fact_checks = star["fact_sales"].agg(
        count.alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{n}") for n, c in FACT_KEYS.items()],
        F.count_if(off_total("totalamount", "quantity", "price")).alias("mismatch_count"),
        F.round(F.sum(F.col("totalamount").cast(MONEY)), 2).alias("total_revenue"),
    )
    span = star["dim_date"].agg(
        F.date_format(F.min("fulldate"), "yyyyMMdd").alias("start_date"),
        F.date_format(F.max("fulldate"), "yyyyMMdd").alias("end_date"),
    )
    parts = [
        line_checks,
        _long(drift, "ecommerce_clean"),
        freq,
        _long(fact_checks, "fact_sales"),
        _long(distinct_keys(star["dim_customer"], "customerid", "unique_customers"), "dim_customer"),
        _long(distinct_keys(star["dim_product"], "productid", "unique_products"), "dim_product"),
        _long(span, "dim_date"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
