"""Publishing, refreshing, key stores and the run ledger under failures."""

import uuid

import pytest
from pyspark.sql import functions as F

from demandlake import pipeline
from demandlake.operators import gold, ingest
from demandlake.session import stage
from demandlake.sources import adapters, csv_files
from demandlake.sources.catalog import LoadAudit, ensure_namespace
from demandlake.sources.keystore import KeyStore
from demandlake.sources.ledger import RunLedger
from demandlake.sources.publish import Publications, PublishConflict


def lake(spark):
    return pipeline.Lake(spark, f"t{uuid.uuid4().hex[:8]}_", key_buckets=4)


@pytest.fixture
def space(spark):
    name = f"s{uuid.uuid4().hex[:8]}"
    ensure_namespace(spark, name)
    return name


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    """A few postings of six days, some without a day."""
    day = "CASE WHEN date_posted = 'n/a' THEN 'n/a' ELSE concat('199', 7 + seq DIV 12 % 3, '-0', 1 + seq DIV 36 % 2, '-01') END"
    rows = adapters.postings_raw(spark, sf_dir).where("seq % 12 < 2")
    return stage(rows.withColumn("date_posted", F.expr(day)), "postings")


def failing(df):
    """A frame whose plan raises on its rows."""
    return df.withColumn(df.columns[0], F.raise_error(F.lit("broken")).cast(df.schema[0].dataType))


def contents(df):
    return sorted(map(repr, df.collect()))


# --- Publications ------------------------------------------------------------


def test_failed_publication_changes_nothing(spark, space):
    tables = Publications(spark, space)
    one, two = spark.range(5).withColumn("a", F.lit("x")), spark.range(7)
    assert tables.publish({"one": one, "two": two}) == [
        LoadAudit(f"{space}.one", 5, 5), LoadAudit(f"{space}.two", 7, 7)]
    before = spark.table(f"{space}.one")
    with pytest.raises(Exception, match="broken"):
        tables.publish({"one": spark.range(9).withColumn("a", F.lit("y")), "two": failing(two)})
    for found in (before, spark.table(f"{space}.one"), tables.table("one")):
        assert contents(found) == contents(one)
    assert contents(spark.table(f"{space}.two")) == contents(two)
    assert tables.version() == 1
    left = {t.name for t in spark.catalog.listTables(space)}
    assert len([n for n in left if "__v2_" in n]) == 0


def test_publication_carries_other_tables_on(spark, space):
    tables = Publications(spark, space)
    tables.publish({"one": spark.range(5), "two": spark.range(7)})
    tables.publish({"one": spark.range(6)})
    assert {n: df.count() for n, df in tables.snapshot().items()} == {"one": 6, "two": 7}
    # A table may be replaced from itself, with another schema.
    tables.publish({"one": spark.table(f"{space}.one").withColumn("b", F.col("id") * 2)})
    assert spark.table(f"{space}.one").columns == ["id", "b"]
    assert spark.table(f"{space}.one").count() == 6


def test_versions_stay_readable_then_go(spark, space):
    tables = Publications(spark, space, keep=2)
    tables.publish({"one": spark.range(1)})
    first = tables.table("one")
    tables.publish({"one": spark.range(2)})
    assert first.count() == 1
    tables.publish({"one": spark.range(3)})
    versions = [t.name for t in spark.catalog.listTables(space) if t.name.startswith("one__v")]
    assert len(versions) == 2


def test_crash_between_commit_and_views(spark, space, monkeypatch):
    tables = Publications(spark, space)
    tables.publish({"one": spark.range(1)})
    with monkeypatch.context() as patch:
        patch.setattr(tables, "point_views", lambda: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            tables.publish({"one": spark.range(2)})
    assert spark.table(f"{space}.one").count() == 1
    again = Publications(spark, space)
    assert again.table("one").count() == 2
    again.point_views()
    assert spark.table(f"{space}.one").count() == 2


def test_one_of_two_builds_wins(spark, space):
    tables = Publications(spark, space)
    tables.publish({"one": spark.range(1)})
    outcomes = []
    for build in ("bbbbbbbb", "aaaaaaaa", "cccccccc"):
        spark.range(len(build)).write.saveAsTable(f"{space}.one__v2_{build}")
        try:
            tables._commit(2, build, {"one": f"one__v2_{build}"})
            outcomes.append(build)
        except PublishConflict:
            pass
    # The first to come saw no other; the least name is what readers meet from then on.
    assert outcomes == ["bbbbbbbb", "aaaaaaaa"]
    assert tables.current() == {"one": "one__v2_aaaaaaaa"}


def test_half_written_log_entry_is_no_version(spark, space):
    tables = Publications(spark, space)
    tables.publish({"one": spark.range(1), "two": spark.range(1)})
    half = spark.table(f"{space}.publications").limit(1).withColumn("version", F.lit(2).cast("long"))
    half.write.mode("append").saveAsTable(f"{space}.publications", format="parquet")
    assert tables.version() == 1 and set(tables.current()) == {"one", "two"}


def test_table_of_before_is_taken_over(spark, space):
    spark.range(4).write.saveAsTable(f"{space}.one")
    Publications(spark, space).publish({"one": spark.range(5)})
    assert spark.table(f"{space}.one").count() == 5


# --- Gold ----------------------------------------------------------------------


def test_failed_gold_build_leaves_all_tables(spark, raw, monkeypatch):
    home = lake(spark)
    pipeline.run_daily(home, raw, ["seq"])
    names = [*pipeline.GOLD_SCHEMAS, pipeline.FACT_TABLE]
    before = {n: contents(spark.table(home.table("gold", n))) for n in names}
    real = gold.fact_job_posting
    monkeypatch.setattr(gold, "fact_job_posting", lambda s: failing(real(s)))
    with pytest.raises(Exception, match="broken"):
        pipeline.build_gold(home)
    assert {n: contents(spark.table(home.table("gold", n))) for n in names} == before


def files(spark, table):
    return set(spark.table(table).inputFiles())


def fact_rows(df):
    return sorted(map(repr, df.drop("clean_time").select(sorted(set(df.columns) - {"clean_time"})).collect()))


def test_refresh_touches_the_dates_of_the_delta_only(spark, raw):
    home = lake(spark)
    day = "1998-02-01"
    first = raw.where((F.col("date_posted") != day) | (F.col("seq") % 5 == 0))
    pipeline.run_daily(home, first, ["seq"])
    target = home.table("gold", home.marts.current()[pipeline.FACT_TABLE])
    before = files(spark, target)
    assert len(before) >= 6
    audits = pipeline.run_daily(home, raw, ["seq"])
    assert audits[-1].table.endswith(pipeline.FACT_TABLE) and 0 < audits[-1].added < audits[-1].total
    spark.catalog.refreshTable(target)
    changed = files(spark, target) ^ before
    assert changed and all(f"date_id={day.replace('-', '')}" in f for f in changed)
    refreshed = fact_rows(spark.table(home.table("gold", pipeline.FACT_TABLE)))
    pipeline.build_gold(home)
    assert fact_rows(spark.table(home.table("gold", pipeline.FACT_TABLE))) == refreshed
    # Nothing new, nothing written.
    assert pipeline.refresh_gold(home) == []


def test_failed_refresh_is_done_again(spark, raw, monkeypatch):
    home = lake(spark)
    pipeline.run_daily(home, adapters.earlier_crawl(raw), ["seq"])
    before = contents(spark.table(home.table("gold", pipeline.FACT_TABLE)))
    real = gold.fact_job_posting
    with monkeypatch.context() as patch:
        patch.setattr(gold, "fact_job_posting", lambda s: failing(real(s)))
        with pytest.raises(Exception, match="broken"):
            pipeline.run_daily(home, raw, ["seq"])
    assert contents(spark.table(home.table("gold", pipeline.FACT_TABLE))) == before
    pipeline.refresh_gold(home)
    refreshed = fact_rows(spark.table(home.table("gold", pipeline.FACT_TABLE)))
    pipeline.build_gold(home)
    assert fact_rows(spark.table(home.table("gold", pipeline.FACT_TABLE))) == refreshed


# --- Ledger ----------------------------------------------------------------------


def test_killed_chain_goes_on_at_gold(spark, raw, monkeypatch):
    home, calls = lake(spark), []
    for name in ("load_bronze", "load_silver", "refresh_gold"):
        real = getattr(pipeline, name)
        monkeypatch.setattr(pipeline, name, lambda *a, n=name, f=real: (calls.append(n), f(*a))[1])
    gold_step = pipeline.refresh_gold
    monkeypatch.setattr(pipeline, "refresh_gold", lambda home: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        pipeline.run_daily(home, raw, ["seq"], run="monday")
    assert calls == ["load_bronze", "load_silver"]
    states = {r["step"]: r["state"] for r in home.ledger.states().collect()}
    assert states == {"bronze": "done", "silver": "done", "gold": "failed"}
    monkeypatch.setattr(pipeline, "refresh_gold", gold_step)
    audits = pipeline.run_daily(home, raw, ["seq"], run="monday")
    assert calls == ["load_bronze", "load_silver", "refresh_gold"]
    kept = home.ledger.audits().orderBy("at").collect()
    assert [(r["table"], r["added"], r["total"]) for r in kept if r["step"] != "gold"] == [tuple(a) for a in audits[:2]]
    assert {(r["table"], r["added"], r["total"]) for r in kept} == {tuple(a) for a in audits}
    # Under another name everything is done anew.
    pipeline.run_daily(home, raw, ["seq"], run="tuesday")
    assert calls[3:] == ["load_bronze", "load_silver", "refresh_gold"]


def test_ledger_of_nothing(spark, space):
    ledger = RunLedger(spark, f"{space}.ledger")
    assert ledger.done("run", "chain") == {}
    assert ledger.open("chain").step("only", lambda: []) == []
    assert ledger.audits().count() == 0 and ledger.states().count() == 1


# --- Raw merge -------------------------------------------------------------------


def test_raw_merges_need_no_path(spark, raw, tmp_path, monkeypatch):
    home, crawls = lake(spark), {}
    rows = raw.drop("seq")
    for name, part in (("old", adapters.earlier_crawl(rows)), ("new", adapters.later_crawl(rows))):
        crawls[name] = str(tmp_path / name)
        part.write.options(**csv_files.DIALECT).csv(crawls[name])
    first = pipeline.run_manual(home, crawls["old"])
    # A crash after the merged crawl is written and before it is current.
    with monkeypatch.context() as patch:
        patch.setattr(home.raw, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            pipeline.run_manual(home, crawls["new"])
    assert home.raw.table(pipeline.RAW_TABLE).count() == first[0].total
    second = pipeline.run_manual(home, crawls["new"])
    merged = home.raw.table(pipeline.RAW_TABLE)
    assert second[0].total == raw.select("job_link").distinct().count() == merged.count()
    again = pipeline.run_manual(home, crawls["new"])
    assert again[0].total == second[0].total and again[1].added == again[2].added == 0
    expected = ingest.merge_raw(*(csv_files.read_postings_csv(spark, crawls[n]) for n in ("old", "new")))
    assert contents(merged.select(sorted(merged.columns))) == contents(expected.select(sorted(merged.columns)))
    assert spark.table(home.table("bronze", pipeline.RAW_TABLE)).count() == merged.count()


def test_merged_crawl_keeps_awkward_texts(spark, tmp_path):
    home = lake(spark)
    rows = [("a", 'say "hi", all\nof you '), ("b", None), ("c", "x\\Ny"), (None, " lead")]
    new = spark.createDataFrame(rows, "job_link string, job_title string")
    pipeline.merge_crawl(home, new)
    pipeline.merge_crawl(home, new.limit(0).withColumn("more", F.lit("x")))
    found = {(r["job_link"], r["job_title"], r["more"]) for r in home.raw.table(pipeline.RAW_TABLE).collect()}
    assert found == {(*r, None) for r in rows}


# --- Key store -------------------------------------------------------------------


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_keys_are_not_shuffled(spark, space, raw, no_broadcast, capsys):
    store = KeyStore(spark, f"{space}.links", "job_link", buckets=4)
    earlier = adapters.earlier_crawl(raw)
    assert store.unseen(raw).count() == raw.count()
    store.add(earlier.select("job_link").distinct())
    fresh = store.unseen(raw)
    fresh.explain("formatted")
    plan = capsys.readouterr().out
    tree = plan[:plan.index("\n\n\n")]
    assert tree.count("Exchange") == 1 and "SortMergeJoin LeftAnti" in tree
    # The one exchange is the batch's, which comes first.
    assert tree.index("Exchange") < tree.index(f"{space}.links")
    wanted = ingest.bronze_delta(raw, earlier, ["seq"]).drop("ingest_time", "source")
    assert contents(ingest.unseen_rows(raw, store, ["seq"]).select(wanted.columns)) == contents(wanted)


def test_store_catches_up_and_is_compacted(spark, space, monkeypatch):
    from demandlake.sources import keystore

    store = KeyStore(spark, f"{space}.links", "k", buckets=2)
    keys = spark.range(100).select(F.col("id").cast("string").alias("k"))
    assert store.sync(keys) == 100
    assert store.sync(keys) == 0
    # A load that added rows and was killed before it added their keys.
    more = spark.range(150).select(F.col("id").cast("string").alias("k"))
    assert store.sync(more) == 50 and store.keys().distinct().count() == store.keys().count() == 150
    assert not store.compact()
    monkeypatch.setattr(keystore, "MOST_LOADS", 1)
    assert store.compact() and contents(store.keys()) == contents(more) and store.buckets() == 2
    assert store.unseen(more.union(spark.createDataFrame([(None,), ("new",)], "k string"))).collect()[0][0] == "new"


def test_killed_bronze_load_does_not_double(spark, raw, monkeypatch):
    home = lake(spark)
    with monkeypatch.context() as patch:
        patch.setattr(KeyStore, "add", lambda self, keys: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            pipeline.load_bronze(home, raw, ["seq"])
    audit = pipeline.load_bronze(home, raw, ["seq"])
    assert audit.added == 0 and audit.total == raw.select("job_link").distinct().count()
