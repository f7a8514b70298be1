"""Features of order lines, products and customers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.functions.numeric import money_avg, money_sum
from demandlake.operators.ranks import quantiles
from demandlake.session import stage

# The columns of the feature table.
FEATURE_COLUMNS = (
    "customer_id", "product_id", "order_date", "year", "month", "day", "dow",
    "quantity", "price", "total_price", "review_score", "payment_method", "city",
    "gender", "age", "prod_total_qty", "prod_avg_price", "prod_unique_buyers",
)
MISSING_CATEGORY = "NA"
# Equal rows that one task draws from at a time.
COPIES = 100_000


def time_features(lines: DataFrame) -> DataFrame:
    day = F.col("order_date")
    return lines.withColumns({
        "year": F.year(day),
        "month": F.month(day),
        "day": F.dayofmonth(day),
        "dow": F.dayofweek(day),
    })


def product_stats(lines: DataFrame) -> DataFrame:
    """Per product; buyers are deduplicated before the product shuffle."""
    return lines.groupBy("product_id").agg(
        F.sum("quantity").alias("prod_total_qty"),
        money_avg(F.col("price")).alias("prod_avg_price"),
        F.count_distinct("customer_id").alias("prod_unique_buyers"),
    )


def product_features(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """Order lines with the statistics of their product.

    ``stats`` should be a stored table: the planner then broadcasts it when it is
    small, and otherwise splits a product that holds much of the lines.
    """
    return lines.join(stats, "product_id", "left")


def order_line_features(lines: DataFrame, stats: DataFrame) -> DataFrame:
    # Parts of the date are added after the join, so that it does not move them.
    joined = time_features(product_features(lines, stats))
    return joined.select(*FEATURE_COLUMNS).withColumn(
        "payment_method", F.upper(F.trim("payment_method"))
    )


def customer_rfm_days(lines: DataFrame) -> DataFrame:
    return lines.groupBy("customer_id").agg(
        F.max("order_date").alias("last_purchase"),
        F.count_distinct("order_date").alias("freq_days"),
        money_sum(F.col("total_price")).alias("monetary"),
    )


def rfm(lines: DataFrame) -> DataFrame:
    """Recency in days to the latest order of all, order-line count and spend per customer."""
    customers = lines.groupBy("customer_id").agg(
        F.max("order_date").alias("last_purchase"),
        F.count(F.lit(1)).alias("frequency"),
        money_sum(F.col("total_price")).alias("monetary"),
    )
    customers = stage(customers, "customers")
    latest = customers.agg(F.max("last_purchase").alias("latest"))
    return customers.crossJoin(F.broadcast(latest)).select(  # one row
        "customer_id",
        F.date_diff("latest", "last_purchase").alias("recency"),
        "frequency",
        "monetary",
    )


def ensure_columns(
    df: DataFrame, numbers: Sequence[str], texts: Sequence[str] = ()
) -> DataFrame:
    """Missing number columns as 0 and missing text columns as NULL."""
    missing = {c: F.lit(0) for c in numbers if c not in df.columns}
    missing |= {c: F.lit(None).cast("string") for c in texts if c not in df.columns}
    return df.withColumns(missing)


def median(df: DataFrame, column: str) -> float | None:
    """Exact median of a column, whatever its number of distinct values; None without any."""
    return quantiles(df, column)[0]


def impute(features: DataFrame) -> DataFrame:
    """Payment NULL → 'NA', review NULL → 0, age NULL → median age (0 when all are NULL)."""
    middle = median(features, "age")
    return features.withColumns({
        "payment_method": F.coalesce("payment_method", F.lit(MISSING_CATEGORY)),
        "review_score": F.coalesce("review_score", F.lit(0)),
        "age": F.coalesce(F.col("age").cast("double"), F.lit(0.0 if middle is None else middle)),
    })


def representative(lines: DataFrame) -> DataFrame:
    """The latest order line of each product; ties go by the remaining columns.

    One aggregate over the lines themselves, so a popular product is reduced before the
    shuffle; join the statistics of the products afterwards.
    """
    others = sorted(c for c in lines.columns if c not in ("product_id", "order_date"))
    ranked = F.struct((-F.unix_date("order_date")).alias("__age"), "order_date", *others)
    latest = lines.groupBy("product_id").agg(F.min(ranked).alias("row"))
    return latest.select("product_id", "row.*").drop("__age").select(*lines.columns)


def sample_rows(df: DataFrame, fraction: float = 0.10, seed: int = 42) -> DataFrame:
    """A Bernoulli sample drawn from the rows themselves: the same rows in every run and in
    any partitioning, and no copy of the input.

    A row is drawn by its hash and by which of its equals it is. Rows that have an equal are
    told by counting hashes; they alone are grouped, and each of a group is drawn by itself.
    """
    identity = F.xxhash64(F.lit(seed), *df.columns)
    hashed = df.withColumn("__identity", identity)
    repeated = hashed.groupBy("__identity").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = stage(repeated.select("__identity"), "repeated-rows")

    def drawn(occurrence: Column) -> Column:
        # The upper 53 bits of a hash, as a number from 0 to 1.
        draw = F.shiftrightunsigned(F.xxhash64("__identity", occurrence), 11) / F.lit(2.0**53)
        return draw < F.lit(fraction)

    # Drawn first: the join then meets a fraction of the rows.
    single = hashed.where(drawn(F.lit(0).cast("long"))).join(repeated, "__identity", "left_anti")
    groups = hashed.join(repeated, "__identity", "left_semi").groupBy("__identity", *df.columns).agg(
        F.count(F.lit(1)).alias("__n")
    )
    # Numbered in blocks, so that a row of any number of copies is dealt to many tasks.
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long")))
    blocks = groups.withColumn("__first", first).repartition("__identity", "__first")
    last = F.least(F.col("__first") + COPIES, F.col("__n")) - 1
    copies = blocks.withColumn("__copy", F.explode(F.sequence("__first", last)))
    return single.select(*df.columns).unionAll(copies.where(drawn(F.col("__copy"))).select(*df.columns))
