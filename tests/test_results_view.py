"""The AUROC table of stored predictions, against plain counting."""

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from selroute.operators import metrics
from selroute.plans.views import Views
from selroute.sources.tables import OPEN_FILES, write_predictions


def test_results_group_by_one_number_and_are_written_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i * 7,) for i in range(30)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    views, grouped = Views(spark, str(tmp_path)), []
    running = metrics.value_running
    monkeypatch.setattr(metrics, "value_running", lambda df, keys, *a, **kw: grouped.append([df.schema[k].dataType.simpleString() for k in keys]) or running(df, keys, *a, **kw))
    found = {tuple(r)[:6]: r.auroc for r in views.results.collect()}
    assert grouped == [["int"]]  # names of models and rules stay out of the counts of a score
    assert "Window" not in views.results._jdf.queryExecution().executedPlan().toString()
    rows = {}
    for r in views.predictions.collect():
        rows.setdefault((r.model, r.f1, r.bleu, r.similarity, r.run, r.epoch), []).append((r.logit, r.label))
    assert len(rows) == len(found) == 10 * 47 * 9
    for key, own in rows.items():
        pairs = [(a > b) + (a == b) / 2 for a, y in own if y for b, z in own if not z]
        assert found[key] is None if not pairs else abs(found[key] - sum(pairs) / len(pairs)) < 1e-9


def test_scores_of_a_classifier_are_counted_in_one_task(spark, tmp_path, monkeypatch):
    spark.range(90).selectExpr("id * 7 AS doc_id").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    counted, running = [], metrics.value_running
    monkeypatch.setattr(metrics, "value_running", lambda df, *a, **kw: counted.append(df) or running(df, *a, **kw))
    views = Views(spark, str(tmp_path))
    views.results
    places = counted[0].select("cell", F.spark_partition_id().alias("task")).distinct()
    assert places.count() == 10 * 47 * 9 and places.select("task").distinct().count() > 1
    assert counted[0].count() == views.predictions.count()


def test_predictions_are_stored_with_their_files_open(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS row_id", "concat('model_', id % 40) AS model", "id / 7 AS logit")  # more models than open files
    setting, held = "spark.sql.maxConcurrentOutputFileWriters", []
    before, write = spark.conf.get(setting), DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: held.append(int(spark.conf.get(setting))) or write(self, path))
    write_predictions(rows, f"{tmp_path}/store")
    assert held == [OPEN_FILES] and OPEN_FILES > 10  # with 0 all rows are sorted before they are written
    assert spark.conf.get(setting) == before
    back = spark.read.parquet(f"{tmp_path}/store").select("row_id", "model", "logit")
    assert back.exceptAll(rows).isEmpty() and back.count() == 3000
