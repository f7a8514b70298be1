"""Views that reshape the TPC-H-like test tables into the engine's two inputs.

Both plant dirty values and NULLs over every row of the underlying tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as crawled job postings; ``seq`` gives the crawl order."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    parts = part.select(F.count(F.lit(1))).scalar()
    joined = (
        orders.withColumn("title_key", F.col("o_orderkey") % parts)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("title_key") == F.col("p_partkey"))
    )
    return joined.selectExpr(
        "concat('  ', lower(p_name), ' ') AS job_title",
        "CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE concat(' ', lower(c_name), ' ') END"
        " AS company_name",
        "CASE o_orderkey % 7 WHEN 0 THEN 'TP.HCM - Ha Noi' WHEN 1 THEN 'HaNoi'"
        " WHEN 2 THEN 'Da Nang ' WHEN 3 THEN 'Ho Chi Minh' WHEN 4 THEN n_name"
        " WHEN 5 THEN '' ELSE 'Ha Noi - Da Nang' END AS location",
        """concat("['", replace(p_name, ' ', "', '"), "', '']") AS skills_required""",
        "CASE WHEN o_orderkey % 97 = 0 THEN 'n/a'"
        " ELSE substr(cast(o_orderdate AS string), 1, 10) END AS date_posted",
        "concat('https://jobs.example/',"
        " o_orderkey - CASE WHEN o_orderkey % 11 = 1 THEN 1 ELSE 0 END) AS job_link",
        "CASE o_orderpriority WHEN '1-URGENT' THEN ' data analyst'"
        " WHEN '2-HIGH' THEN 'backend engineer ' WHEN '3-MEDIUM' THEN 'DevOps'"
        " WHEN '4-NOT SPECIFIED' THEN 'QA tester' ELSE 'AI researcher' END AS job_category",
        "CASE o_orderkey % 6 WHEN 0 THEN ' At Office' WHEN 1 THEN 'Hybrid'"
        " WHEN 2 THEN 'Remote' WHEN 3 THEN 'WFH' WHEN 4 THEN NULL ELSE 'flexible' END"
        " AS work_mode",
        "o_orderkey AS seq",
    )


# Postings dated before this day play the part of what an earlier load stored.
EARLIER_CRAWL_END = "1999-01-01"


def earlier_crawl(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("date_posted") < EARLIER_CRAWL_END)


def later_crawl(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("date_posted") >= EARLIER_CRAWL_END)


def ecommerce_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their product, customer and payment attributes."""
    lineitem = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    joined = (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.selectExpr(
        "o_custkey AS customer_id",
        "l_partkey AS product_id",
        "cast(o_orderdate AS date) AS order_date",
        "p_type AS category_name",
        "cast(l_quantity AS int) AS quantity",
        "floor(100 * l_extendedprice / l_quantity) / 100D AS price",
        "l_extendedprice AS total_price",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE cast(1 + o_orderkey % 5 AS int) END"
        " AS review_score",
        "concat(' ', lower(o_orderpriority)) AS payment_method",
        "n_name AS city",
        "CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender",
        "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE cast(18 + c_custkey % 50 AS int) END AS age",
    )


def sales_star(lines: DataFrame) -> dict[str, DataFrame]:
    """The retail star the quality checks look at, as views of the order lines."""
    return {
        "fact_sales": lines.selectExpr(
            "customer_id AS customerkey",
            "product_id AS productkey",
            "category_name AS categorykey",
            "city AS citykey",
            "payment_method AS paymentkey",
            "cast(date_format(order_date, 'yyyyMMdd') AS int) AS datekey",
            "quantity",
            "price",
            "total_price AS totalamount",
        ),
        "dim_customer": lines.selectExpr("customer_id AS customerid").distinct(),
        "dim_product": lines.selectExpr("product_id AS productid").distinct(),
        "dim_date": lines.selectExpr("order_date AS fulldate").distinct(),
    }
