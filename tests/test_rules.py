"""Edge rows of the cleaning, gold, series and pricing rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandlake.functions import dates, keys, rules
from demandlake.operators import gold, ingest, pricing, retail, series, silver
from demandlake.session import build_session, scratch_root
from demandlake.sources import csv_files

DAY = dt.date


def values(spark, rows, rule):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("raw"))).collect()]


def test_work_mode(spark):
    raw = [None, " Office / Hybrid", "Partly remote", "WFH", "flexible"]
    assert values(spark, raw, rules.work_mode) == ["At Office", "At Office", "Hybrid", "Remote", "At Office"]


def test_location(spark):
    raw = ["TP.HCM - HaNoi", "ho chi minh", " Da Nang ", "", None]
    assert values(spark, raw, rules.cities) == [
        ["Ho Chi Minh", "Ha Noi"], ["ho chi minh"], ["Da Nang"], [""], None,
    ]
    assert values(spark, raw, rules.first_city)[3:] == [None, None]


def test_skills(spark):
    assert values(spark, ["['Java', '', 'C#' ]", "[]", None], rules.skills) == [["JAVA", "C#"], [], None]


def test_category_groups(spark):
    raw = ["ai engineer", "AI", "DevOps", "QA tester", "c-level"]
    found = values(spark, raw, lambda c: rules.category_group(rules.category_name(c)))
    assert found == ["Software Engineering", "Other", "Other", "QA / Testing", "Management"]


def test_skill_groups(spark):
    raw = ["POSTGRESQL", "AWS DATA", "REACTJS", "GO"]
    assert values(spark, raw, rules.skill_group) == ["Data/Backend", "Data/Backend", "Frontend", "Other"]


def posting(link, **change):
    row = {
        "job_title": "  data ENGINEER ", "company_name": " fpt software ", "location": "HaNoi",
        "skills_required": "['Go', 'Sql']", "date_posted": "2025-11-30", "job_link": link,
        "job_category": "data", "work_mode": None,
    }
    return {**row, **change}


def postings(spark, *rows):
    names = list(posting(""))
    return spark.createDataFrame(
        [tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names)
    )


def test_clean_postings(spark):
    raw = postings(
        spark, posting("a"), posting("a", job_title="zzz"), posting("b", date_posted="n/a"),
        posting("c", location=""), posting(None), posting("d", company_name=" "),
    )
    rows = silver.clean_postings(raw).collect()
    assert [r["job_link"] for r in rows] == ["a"]
    assert (rows[0]["job_title"], rows[0]["company_name"]) == ("Data Engineer", "FPT SOFTWARE")
    assert silver.clean_postings(raw.limit(0)).count() == 0


def test_header_names(spark):
    df = spark.createDataFrame([(1,)], "` Job Title ` int")
    assert silver.normalise_headers(df).columns == ["job_title"]


def test_same_batch_twice_adds_nothing(spark):
    raw = postings(spark, posting("a"), posting("b"), posting(None))
    bronze = ingest.bronze_delta(raw, raw.limit(0))
    assert bronze.count() == 2
    assert ingest.bronze_delta(raw, bronze).count() == 0


def test_merge_takes_differing_headers(spark):
    old = spark.createDataFrame([("a", 1)], "job_link string, x int")
    new = spark.createDataFrame([("a", 2), ("b", 3)], "job_link string, y int")
    rows = {r["job_link"]: (r["x"], r["y"]) for r in ingest.merge_raw(old, new).collect()}
    assert rows == {"a": (1, None), "b": (None, 3)}


def test_dimensions_and_fact(spark):
    clean = silver.clean_postings(postings(
        spark, posting("a"), posting("b", skills_required="[]"), posting("c", skills_required=None),
        posting("d", skills_required="['go', 'GO']"),
    ))
    dims = gold.dimensions(clean)
    assert {r["skill_name"] for r in dims["dim_skill"].collect()} == {"GO", "SQL"}
    fact = gold.fact_job_posting(clean)
    assert sorted(r["job_link"] for r in fact.collect()) == ["a", "a", "d"]
    joined = gold.star_join(fact, dims)
    assert joined.filter("skill_name IS NULL OR city IS NULL OR category_name IS NULL").count() == 0
    assert fact.select("fact_id").distinct().count() == fact.count()
    assert gold.dim_work_mode(clean.drop("work_mode")) is None
    assert gold.fact_job_posting(clean.drop("work_mode")).filter("mode_id IS NOT NULL").count() == 0


def test_keys_are_not_negative(spark):
    df = spark.range(5000).select(keys.hash_key(F.col("id")).alias("k"))
    assert df.agg(F.min("k")).first()[0] >= 0


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "b", c\nd', "", None), ("", None, " x ")]
    df = spark.createDataFrame(rows, "p string, q string, r string")
    csv_files.write_csv(df, str(tmp_path / "out"))
    back = csv_files.read_postings_csv(spark, str(tmp_path / "out"), ["p", "q", "r"], csv_files.NULL_MARKER)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)


def test_csv_with_mark_and_quotes(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("﻿a,b\r\n\"x \"\"y\"\", z\n2\",\r\n".encode())
    row = csv_files.read_postings_csv(spark, str(path)).collect()[0]
    assert row.asDict() == {"a": 'x "y", z\n2', "b": None}


def points(spark, *rows):
    return spark.createDataFrame(rows, "job_category string, ds date, y double")


def test_weekly_interpolation(spark):
    df = points(
        spark, ("A", DAY(2025, 11, 2), 10.0), ("A", DAY(2025, 11, 5), 99.0), ("A", DAY(2025, 11, 16), 30.0),
        ("A", DAY(2025, 11, 19), 77.0), ("B", DAY(2025, 11, 5), 5.0), ("B", DAY(2025, 11, 7), 6.0),
        ("B", DAY(2025, 11, 23), 9.0),
    )
    found = sorted((r["job_category"], r["ds"].day, r["y"]) for r in series.weekly_interpolate(df).collect())
    assert found == [("A", 2, 10.0), ("A", 9, 20.0), ("A", 16, 30.0), ("A", 23, 30.0), ("B", 23, 9.0)]


@pytest.mark.parametrize("n, train", [(3, 2), (5, 4)])
def test_split(spark, n, train):
    df = points(spark, *[("A", DAY(2025, i + 1, 1), 1.0) for i in range(n)])
    assert series.split_by_time(df).filter("is_train").count() == train


def test_future_frame(spark):
    df = points(spark, ("A", DAY(2025, 11, 1), 1.0), ("B", DAY(2025, 11, 30), 1.0))
    future = series.future_frame(df).filter("kind = 'future'")
    found = {}
    for r in future.collect():
        found.setdefault(r["job_category"], []).append(r["ds"])
    assert sorted(found["A"]) == [DAY(2025, 11, 30), DAY(2025, 12, 31), DAY(2026, 1, 31)]
    assert sorted(found["B"]) == [DAY(2025, 12, 31), DAY(2026, 1, 31), DAY(2026, 2, 28)]
    assert series.future_frame(df, periods=0).count() == 2


def test_one_test_point_has_no_r2(spark):
    df = spark.createDataFrame([("A", 2.0, 1.0)], "job_category string, y double, yhat double")
    row = series.forecast_metrics(df).collect()[0]
    assert (row["MAE"], row["R2_Score"]) == (1.0, None)


def test_price_grid(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 5.0)], "product_id int, prod_avg_price double, price double")
    rows = pricing.price_grid(df).orderBy("grid_index").collect()
    assert [r["product_id"] for r in rows] == [2] * 15
    assert (round(rows[0]["price"], 9), round(rows[14]["price"], 9)) == (70.0, 130.0)
    assert pricing.price_grid(df, points=1).count() == 1
    flat = pricing.price_grid(df).withColumn("predicted_quantity", 1 / F.col("price"))
    equal = flat.withColumn("price", F.lit(1.0)).withColumn("predicted_quantity", F.lit(1.0))
    assert pricing.best_price(equal).collect()[0]["best_price"] == 1.0


def test_missing_feature_columns(spark):
    df = spark.createDataFrame([(1,)], "quantity int")
    row = pricing.training_frame(df.withColumn("age", F.lit(None).cast("int"))).collect()[0]
    assert (row["price"], row["payment_method"], row["age"]) == (0.0, "NA", 0.0)


def test_sample_draws_equal_rows_apart(spark):
    df = spark.range(2000).select(F.lit(1).alias("x"))
    assert 100 < retail.sample_rows(df).count() < 320


def test_scratch_without_setting(spark):
    assert scratch_root(spark) == scratch_root(build_session())


def test_month_ends_of_no_period(spark):
    row = spark.range(1).select(dates.month_ends_after(F.lit(DAY(2025, 1, 1)), 0).alias("d")).first()
    assert row["d"] == []


def test_demand_queries_train_the_whole_model(spark, monkeypatch):
    import inspect

    from demandlake import queries
    from demandlake.operators import pricing

    signature, asked = inspect.signature(pricing.fit_demand), []

    def fit(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        asked.append(bound.arguments["trees"])

    monkeypatch.setattr(pricing, "fit_demand", fit)
    monkeypatch.setattr(pricing, "training_frame", lambda features: features)
    queries._demand(spark.range(3))
    assert asked == [pricing.TREES] == [1000]
