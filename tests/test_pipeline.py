"""The chains over the small tables."""

import uuid

from demandlake import pipeline
from demandlake.sources import adapters, csv_files


def lake(spark):
    return pipeline.Lake(spark, f"t{uuid.uuid4().hex[:8]}_", key_buckets=4)


def test_daily_chain_twice(spark, sf_dir):
    raw = adapters.postings_raw(spark, sf_dir)
    home = lake(spark)
    first = pipeline.run_daily(home, adapters.earlier_crawl(raw), ["seq"])
    second = pipeline.run_daily(home, raw, ["seq"])
    third = pipeline.run_daily(home, raw, ["seq"])
    assert first[0].added > 0 and second[0].added > 0 and third[0].added == 0 == third[1].added
    assert second[0].total == raw.select("job_link").distinct().count()
    fact = spark.table(home.table("gold", "fact_job_posting"))
    assert fact.count() == second[-1].total > 0 and len(third) == 2
    audits = pipeline.run_forecast(home)
    assert all(a.total > 0 for a in audits)


def test_manual_chain(spark, sf_dir, tmp_path):
    raw = adapters.postings_raw(spark, sf_dir).drop("seq")
    for name, part in (("old", adapters.earlier_crawl(raw)), ("new", adapters.later_crawl(raw))):
        csv_files.write_csv(part, str(tmp_path / name))
    audits = pipeline.run_manual(lake(spark), *(str(tmp_path / n) for n in ("old", "new")))
    assert audits[2].added == raw.select("job_link").distinct().count()


def test_full_chain(spark, sf_dir, tmp_path):
    """All chains in one run, then the same run again: every step is done already."""
    home = lake(spark)
    inputs = (
        adapters.postings_raw(spark, sf_dir), adapters.ecommerce_clean(spark, sf_dir), str(tmp_path / "exports")
    )
    audits = pipeline.run_full(home, *inputs, order=["seq"], trees=5, run="one")
    assert all(a.total > 0 for a in audits)
    names = {a.table.split(".")[1] for a in audits}
    assert {"it_jobs_raw", "it_jobs_clean", "dim_skill", "fact_job_posting", "ml_forecast_jobs", "data_quality",
            "features_sample", "price_recommendations", "customer_cluster"} <= names
    assert set(home.marts.current()) == names - {"it_jobs_raw", "it_jobs_clean"}
    [attempt] = (tmp_path / "exports").iterdir()
    for name, table in (("prices", "price_recommendations"), ("sample", "features_sample")):
        export = spark.read.options(**csv_files.EXPORT).csv(str(attempt / name))
        assert export.count() == spark.table(home.table("gold", table)).count()
    assert home.ledger.audits().count() == len(audits)
    assert pipeline.run_full(home, *inputs, order=["seq"], trees=5, run="one") == audits
    assert len(list((tmp_path / "exports").iterdir())) == 1
