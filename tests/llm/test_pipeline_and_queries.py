from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, messy, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 1 if i % 5 else 0, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    item = messy.filter("doc_id = 8").first().text
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_takes_messy_tables(spark, crowded, nothing, folder, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "REJECT_BELOW", 0.0)
    for docs in (crowded, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            assert Counter(r.doc_id for r in out.collect()) <= Counter(r.doc_id for r in docs.collect())
        encoded = corpus_pipeline.encode(spark, docs, folder)
        assert encoded.count() == docs.count() and encoded.filter("not round_trip").count() == 0


def test_stage_decisions(spark, messy, folder):
    near = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, messy, folder).collect()}
    assert {0, 5, 304, 305} <= near and near.isdisjoint({*range(100, 125), 302, 303})
    assert 8 not in {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, messy, folder).collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, messy, folder).collect()} & {5, 300, *range(100, 125)} == {300}


def test_quality_stage_rejects_what_the_classifier_rejects(spark, folder, monkeypatch):
    """The score of a text is its length in hundredths here; what is below one half goes."""
    docs = spark.createDataFrame([(n, "x" * n) for n in (0, 10, 26, 40, 49, 50, 51, 90)], "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline.pu_quality, "score_column", lambda text, model: F.length(text) / 100)
    assert {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, folder).collect()} == {50, 51, 90}


def test_run_chains_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) < docs.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_registration():
    names = spark_entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert {"op2_exact_dedup", "op3_url_rules", "op5_benchmark_decontamination"} <= set(spark_entry.oracle_sql())
