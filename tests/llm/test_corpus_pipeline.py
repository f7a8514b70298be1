"""The pipeline over the smallest tables, stage by stage."""

import brute
import corpus_pipeline

from demandlake.llm import queries
from demandlake.llm.tables import DOCUMENT_COLUMNS, table


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    kept = {}
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()] if i < 3 else None
        hosts = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()] if i == 0 else None
        step(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = {r["doc_id"] for r in docs.collect()}
        if i < 4:
            assert tuple(docs.columns) == DOCUMENT_COLUMNS
        if name == "quality rules":
            assert kept[name] == {d for d, (stays, _) in brute.boilerplate(hosts).items() if stays}
        if name == "near-dedup":
            assert kept[name] == {r[0] for r in brute.near_dedup(before) if r[-1]}
        if name == "decontamination":
            items = [r["text"].lower() for r in table(spark, sf_dir, "benchmark").collect()]
            held = {d for d, t in before if any(i in t.lower() for i in items)}
            assert held <= {d for d, _ in before} - kept[name]
    assert kept["secret scan"] == kept["decontamination"] == kept["packing"]


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_all_operators_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
