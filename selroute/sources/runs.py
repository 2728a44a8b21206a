"""Benchmark run folders: three JSON array files per folder, flattened and joined."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selroute.functions.paths import decoded, run_folder_task
from selroute.operators.reshape import flatten_struct
from selroute.schemas import INSTANCES, PREDICTIONS, REQUESTS


def with_required(found: T.StructType, required: T.StructType) -> T.StructType:
    """``found`` with the fields of ``required`` in their required types, nested structs merged, everything else kept."""
    fields = {f.name: f for f in found.fields}
    for f in required.fields:
        have = fields.get(f.name)
        if have and isinstance(have.dataType, T.StructType) and isinstance(f.dataType, T.StructType):
            fields[f.name] = T.StructField(f.name, with_required(have.dataType, f.dataType))
        else:
            fields[f.name] = f
    return T.StructType(list(fields.values()))


def infer_elements(spark: SparkSession, root: str, name: str) -> T.StructType:
    """Merged schema of the elements of all array files, by one aggregate over the parsed files.

    Decimal fractions are read as doubles; fields that are always null or of mixed types as text.
    """
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    found = reader.text(root).agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0]
    found = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", re.sub(r"\b(VOID|VARIANT)\b", "STRING", found)).replace("OBJECT<", "STRUCT<")
    elements = T.StructType.fromDDL(f"rows {found}")["rows"].dataType
    inner = elements.elementType if isinstance(elements, T.ArrayType) else T.StructType()
    return inner if isinstance(inner, T.StructType) else T.StructType()


def read_array_files(spark: SparkSession, root: str, name: str, required: T.StructType, schema: T.StructType | None = None) -> DataFrame:
    """Scan the files called ``name`` below ``root``, each one JSON array; the file's folder becomes a column.

    All fields are kept: without a ``schema`` it is inferred in one pass over the files, and the ``required`` fields, which the rules
    use, are there in any case. Run folders have colons in their names, which path globs cannot expand, so the folders are listed.
    """
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    found = schema or infer_elements(spark, root, name)
    raw = reader.schema(with_required(found, required)).json(root)
    return raw.withColumn("folder", F.regexp_replace(decoded(F.col("_metadata.file_path")), r"/[^/]*$", ""))


def join_run_tables(predictions: DataFrame, requests: DataFrame, instances: DataFrame) -> DataFrame:
    """Left joins on (folder, instance_id) of the flattened tables, with task and folder columns.

    A repeated instance id fans out, as the left joins say; ``fan_out`` reports such ids.
    """
    left = flatten_struct(predictions)
    middle = flatten_struct(requests)
    right = flatten_struct(instances).withColumnRenamed("id", "instance_id")
    keys = ["folder", "instance_id"]
    joined = left.join(middle, keys, "left").join(right, keys, "left")
    return joined.withColumn("task", run_folder_task(F.col("folder")))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """All run folders below ``root``."""
    return join_run_tables(
        read_array_files(spark, root, "display_predictions.json", PREDICTIONS),
        read_array_files(spark, root, "display_requests.json", REQUESTS),
        read_array_files(spark, root, "instances.json", INSTANCES),
    )


def fan_out(side: DataFrame, instance: str = "instance_id") -> DataFrame:
    """Instance ids that occur more than once in a folder and so multiply rows in the joins."""
    return side.groupBy("folder", instance).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def write_per_model(df: DataFrame, path: str, model: str = "request_model", mode: str = "errorifexists") -> None:
    """One partition folder per model; rows without a model are not written."""
    named = df.where(F.col(model).isNotNull()).withColumn("model", F.replace(F.col(model), F.lit("/"), F.lit("_")))
    # No repartition by model: a model with a third of all rows would become one task.
    named.write.mode(mode).partitionBy("model").parquet(path)


def read_model(spark: SparkSession, path: str, model: str) -> DataFrame:
    """One model's rows; only its partition folder is listed and read."""
    return spark.read.parquet(path).where(F.col("model") == model)
