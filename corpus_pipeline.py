"""Five stages from raw documents to token ids. Each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selroute.llm import bpe_chunks, decontaminate, exact_dedup, pu_quality, simhash_dedup
from selroute.llm.common import held_out
from selroute.session import scratch_path

# The decision of op9: a document is good from this score on.
REJECT_BELOW = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the positive-unlabelled classifier does not reject. Rows without a text have a score like any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = pu_quality.fit_model(docs, labels, ~held_out("id", 3, 1))
    return docs.filter(pu_quality.score_column(F.col("text"), model) >= REJECT_BELOW)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that is equal without white space: the longest, then the one with the smallest id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose SimHash fingerprints (four-word shingles, four bits at most) are linked: the one with
    the smallest id. Rows without an id stay."""
    return simhash_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and whether decoding gives the text back."""
    return bpe_chunks.encode_checked(docs).select("doc_id", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

# A learnt classifier, fingerprints and a tokenizer are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
