"""Readers and writers on small files, dataset splits, and the trainers on separable toy data."""

import json

import pytest
from pyspark.sql import functions as F

from selroute.operators import splits as S
from selroute.session import shared_dir
from selroute.sources import leaderboard as B
from selroute.sources import runs as H
from selroute.sources import tables as W


def test_run_folders(spark, tmp_path):
    for run, model in (("gsm:model=a", "org/a"), ("mmlu:x=1,model=b+c", "org/b")):
        folder = tmp_path / "runs" / "v1" / run
        folder.mkdir(parents=True)
        predictions = [{"instance_id": i, "predicted_text": f"p{i}", "stats": {"exact_match": 1.0}} for i in ("id1", "id2")]
        requests = [{"instance_id": "id1", "request": {"model": model, "prompt": "q1"}}]
        instances = [{"id": "id1", "input": {"text": "t"}, "references": [{"output": {"text": "r"}, "tags": ["correct"]}]}] * 2
        for name, data in (("display_predictions", predictions), ("display_requests", requests), ("instances", instances)):
            (folder / f"{name}.json").write_text(json.dumps(data))
    table = H.read_runs(spark, str(tmp_path / "runs"))
    assert {"predicted_text", "stats_exact_match", "request_model", "request_prompt", "references", "task", "folder"} <= set(table.columns)
    assert table.count() == 6  # the doubled instance fans out, the unanswered row stays
    assert {r.task for r in table.select("task").distinct().collect()} == {"gsm", "mmlu"}
    assert table.where(F.col("folder").endswith("model=b+c")).count() == 3
    instances = H.read_array_files(spark, str(tmp_path / "runs"), "instances.json", H.INSTANCES).withColumnRenamed("id", "instance_id")
    assert {r.n for r in H.fan_out(instances).collect()} == {2}
    out = str(tmp_path / "models")
    H.write_per_model(table, out)
    assert H.read_model(spark, out, "org_a").count() == 2  # rows without a model are not stored


def test_sample_files(spark, tmp_path):
    folder = tmp_path / "org__model"
    folder.mkdir()
    rows = [{"doc": {"question": "q", "answer": "a"}, "doc_hash": "h1", "exact_match": True}, {"doc": {"x": [1]}, "doc_hash": "h2", "acc": 1.0}]
    name = "samples_some_task_2024-05-06T07-08-09.123.jsonl"
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    got = {r.doc_hash: r for r in B.read_samples(spark, str(folder / "*.jsonl")).collect()}
    assert got["h1"].model == "org__model" and got["h1"].task == "some_task" and got["h1"].timestamp == "2024-05-06T07-08-09.123"
    assert json.loads(got["h1"].doc) == rows[0]["doc"] and got["h1"].exact_match == "true" and got["h2"].acc == "1.0"


def test_latest_file_per_base(spark):
    paths = ["a_2024-01-01T00-00-00.json", "a_2024-02-01T00-00-00.json", "a.json", "b.json", "d-2023-01-01T00-00-00.5.json"]
    got = {r.base: r.path for r in B.latest_per_base(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {"a.json": paths[1], "b.json": "b.json", "d.json": paths[4]}


def test_catalogue_gate(spark):
    cat = spark.createDataFrame([("p/m", True), ("p/x", True), ("q/n", False), ("bare", True)], "fullname string, official boolean")
    listing = spark.createDataFrame([("hub/p__m-details",), ("hub/q__n-details",)], "id string")
    found, missed = B.catalogue_gate(cat, listing, "hub/")
    assert [r.fullname for r in found.collect()] == ["p/m"] and [r.fullname for r in missed.collect()] == ["p/x"]


def test_prediction_keys(spark):
    paths = [("root/results/m/0.1_0.4/3/logits_epoch_7.npy",), ("root/results/m/Een/0/logits_epoch_10.npy",)]
    df = spark.createDataFrame(paths, "p string")
    rows = df.select(*[c.alias(n) for n, c in W.prediction_keys(F.col("p")).items()]).collect()
    assert [tuple(r) for r in rows] == [("m", 0.1, 0.4, None, 3, 7), ("m", None, None, "Een", 0, 10)]


def test_shared_dir_is_the_configured_folder(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


@pytest.mark.parametrize("per_bucket", [4, 1 << 20])
def test_bank_takes_the_most_complete_items(spark, per_bucket):
    rows = [(i, f"m{j}", None if j < i % 4 else 1) for i in range(40) for j in range(4)]
    df = spark.createDataFrame(rows, "sample_id int, model string, correct int")
    parts = S.bank_split(df, 0.2, rows_per_bucket=per_bucket)
    bank = {r.sample_id for r in parts.where("part = 'bank'").collect()}
    assert len(bank) == 8 and all(i % 4 == 0 for i in bank) and parts.count() == 40


def test_missing_rate_counts_absent_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, "a", 1), (3, "b", None)], "sample_id int, model string, correct int")
    got = {r.sample_id: r.missing_rate for r in S.missing_rates(df).collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 1.0}


def test_shared_split_and_fraction(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "sample_id int, model string")
    train, test = S.shared_split(df)
    assert {r.sample_id for r in test.collect()} == {1} and {r.sample_id for r in train.collect()} == {2}
    parts = S.fraction_split(spark.range(11), 42, ["id"], 0.3).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"test": 4, "train": 7}


def test_registry_names_and_contract():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 120
