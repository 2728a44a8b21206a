"""Leaderboard sample files: discovery, newest version per name, catalogue gate and scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selroute.functions.paths import decoded, parent_folder, sample_file_stamp, sample_file_task, stamp, stampless
from selroute.schemas import SAMPLES


def data_files(paths: DataFrame, path: str = "path", without: str = "result") -> DataFrame:
    """Drop the files whose path contains ``without``."""
    return paths.where(~F.contains(F.col(path), F.lit(without)))


def drop_suffix(paths: DataFrame, suffix: str, path: str = "path") -> DataFrame:
    return paths.where(~F.endswith(F.col(path), F.lit(suffix)))


def latest_per_base(paths: DataFrame, keys: tuple[str, ...] = (), path: str = "path") -> DataFrame:
    """(keys, base, stamp, path) of the newest file per base name; unstamped files lose to stamped ones.

    Two aggregates that combine before their shuffle: the first path per stamp, then the greatest stamp.
    """
    parsed = paths.select(
        *keys,
        F.when(stamp(F.col(path)).isNull(), F.col(path)).otherwise(stampless(F.col(path))).alias("base"),
        F.coalesce(stamp(F.col(path)), F.lit("")).alias("stamp"),
        path,
    )
    per_stamp = parsed.groupBy(*keys, "base", "stamp").agg(F.min(path).alias(path))
    newest = per_stamp.groupBy(*keys, "base").agg(F.max(F.struct("stamp", path)).alias("__n"))
    return newest.select(*keys, "base", F.nullif(F.col("__n.stamp"), F.lit("")).alias("stamp"), f"__n.{path}")


def detail_names(catalogue: DataFrame, prefix: str) -> DataFrame:
    """Name of the detail set of every flagged model; names without a provider part are skipped."""
    parts = F.split("fullname", "/")
    name = F.concat(F.lit(prefix), F.get(parts, 0), F.lit("__"), F.get(parts, 1), F.lit("-details"))
    return catalogue.where(F.col("official") & (F.size(parts) >= 2)).select("fullname", name.alias("id"))


def catalogue_gate(catalogue: DataFrame, listing: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(found, missed): flagged models with and without a detail set in the listing."""
    wanted = detail_names(catalogue, prefix)
    present = listing.where(F.endswith(F.col("id"), F.lit("-details"))).select("id")
    return wanted.join(present, "id", "left_semi"), wanted.join(present, "id", "left_anti")


def read_samples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Scan JSON Lines sample files; task, time stamp and model come from the path.

    The fields that the rules use become columns; ``sample`` holds the whole line, so that no field of a file is lost.
    """
    lines = spark.read.text(paths)
    fields = F.from_json("value", SAMPLES.simpleString())
    raw = lines.select(fields.alias("__s"), F.col("value").alias("sample"), "_metadata").select("__s.*", "sample", "_metadata")
    path = decoded(F.col("_metadata.file_path"))
    return raw.withColumns(
        {"task": sample_file_task(path), "timestamp": sample_file_stamp(path), "model": parent_folder(path)}
    )
