"""Labelled sheets, wide matrices, prediction stores and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selroute.operators.reshape import to_long
from selroute.schemas import LABELLED_SHEET
from selroute.session import scratch_path

OPEN_FILES = 16
ROW_GROUP = 16 << 20


def read_sheet(spark: SparkSession, path: str, schema: T.StructType = LABELLED_SHEET) -> DataFrame:
    """Labelled sheet as CSV; quoted texts may span lines."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_sheet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; lists are written as JSON text."""
    flat = df
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            flat = flat.withColumn(field.name, F.to_json(field.name))
    flat.write.mode(mode).csv(path, header=True, escape='"')


def read_wide_matrix(spark: SparkSession, path: str, id_columns: list[str]) -> DataFrame:
    """A ready-made (sample, model_1..n) matrix in long form."""
    return to_long(spark.read.parquet(path), id_columns)


def write_predictions(df: DataFrame, path: str, keys: tuple[str, ...] = ("model",), mode: str = "append") -> None:
    """Logits and labels with their run keys as columns, partitioned by the leading keys.

    A task keeps a file open for each of its first ``OPEN_FILES`` key values, so rows are written as they come; only rows of further
    ones are sorted. Row groups are small, as that many are held at a time."""
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = df.sparkSession.conf.get(setting)
    df.sparkSession.conf.set(setting, str(OPEN_FILES))
    try:
        df.write.mode(mode).option("parquet.block.size", ROW_GROUP).partitionBy(*keys).parquet(path)
    finally:
        df.sparkSession.conf.set(setting, before)


def prediction_keys(path: Column) -> dict[str, Column]:
    """Run keys of a stored prediction path ``<root>/<model>/<rule>/<run>/<name>_<epoch>.<ext>``.

    The rule part is ``<f1>_<bleu>`` or the name of a similarity rule.
    """
    from_end = F.reverse(F.split(path, "/"))
    rule = F.get(from_end, 2)
    cuts = F.split(rule, "_")
    is_grid = F.size(cuts) == 2
    return {
        "model": F.get(from_end, 3),
        "f1": F.when(is_grid, F.get(cuts, 0)).try_cast("double"),
        "bleu": F.when(is_grid, F.get(cuts, 1)).try_cast("double"),
        "similarity": F.when(~is_grid, rule),
        "run": F.get(from_end, 1).try_cast("int"),
        "epoch": F.regexp_extract(F.get(from_end, 0), r"_(\d+)\.", 1).try_cast("int"),
    }


def write_routes(routes: DataFrame, metrics: DataFrame, root: str) -> None:
    """Append chosen models and accuracies of a run to the two result tables."""
    routes.write.mode("append").partitionBy("strategy").parquet(f"{root}/routes")
    metrics.write.mode("append").parquet(f"{root}/router_metrics")


def read_routes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/routes"), spark.read.parquet(f"{root}/router_metrics")


def rewritten(df: DataFrame, name: str = "rewritten") -> DataFrame:
    """Store a table with its added columns at a new path and continue from there.

    A table cannot be overwritten while it is read, so the extended version gets its own path.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
