"""Session construction and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_BRIEF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "selroute", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with UTC time, adaptive execution and skew handling switched on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets its own new folder. On a cluster an
    unset value is an error, because a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can read")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="selroute-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    The plan behind it is cut and lost executors cost no replay. Unlike a checkpoint the data is computed
    once, stays columnar (later reads prune columns) and has a known size, so joins can choose to broadcast.
    """
    path = scratch_path(df.sparkSession, "table")
    with brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries made and run meanwhile go when their query has ended, not when the driver collects garbage."""
    before = spark.conf.get(_BRIEF)
    spark.conf.set(_BRIEF, "true")
    try:
        yield
    finally:
        spark.conf.set(_BRIEF, before)


@contextmanager
def sent(spark: SparkSession, value: object) -> Iterator[Broadcast]:
    """``value`` for the functions of the queries run meanwhile. What a function carries in itself stays with the driver and on the
    executors' disks long after; these copies end here."""
    held = spark.sparkContext.broadcast(value)
    try:
        yield held
    finally:
        held.destroy()
