"""Registered queries of the text operators and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selroute.llm import (
    bpe_chunks,
    conversation_repair,
    decontaminate,
    exact_dedup,
    ngram_trie,
    packing,
    periodic_runs,
    pii,
    pivot_index,
    pu_quality,
    simhash_dedup,
    token_counts,
    url_filter,
)
from selroute.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The rules of op3 (host, path, verdict).
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _register(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register("op1_pii_deobfuscation")
def _op1(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_register(
    "op2_exact_dedup",
    """
    WITH keyed AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
            sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
        FROM documents
    ), ranked AS (
        SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
        FROM keyed WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
    """,
)
def _op2(spark, sf_dir):
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@_register(
    "op3_url_rules",
    """
    WITH parts AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
        FROM pages
    ), judged AS (
        SELECT *, CASE
            WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
            WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
            WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
        FROM parts
    )
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
    """,
)
def _op3(spark, sf_dir):
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


@_register("op4_simhash_near_dedup")
def _op4(spark, sf_dir):
    groups = simhash_dedup.hamming_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@_register(
    "op5_benchmark_decontamination",
    """
    WITH words AS (
        SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents
        UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark
    ), split AS (
        SELECT kind, id, list_filter(string_split_regex(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w
        FROM words
    ), shingles AS (
        SELECT DISTINCT kind, id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
        FROM (SELECT kind, id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM split WHERE len(w) > 0)
        WHERE len(w) >= 5 OR kind = 'b'
    ), items AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'b' GROUP BY id),
    shared AS (
        SELECT d.id AS doc_id, b.id AS item_id, count(*) AS k
        FROM shingles d JOIN shingles b ON d.s = b.s AND d.kind = 'd' AND b.kind = 'b' GROUP BY ALL
    )
    SELECT doc_id, item_id, CAST(k AS INTEGER) AS n_shared, CAST(n AS INTEGER) AS n_item, k / CAST(n AS DOUBLE) AS containment
    FROM shared JOIN items ON items.id = item_id WHERE k / CAST(n AS DOUBLE) >= 0.8
    """,
)
def _op5(spark, sf_dir):
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@_register("op6_bpe_chunks")
def _op6(spark, sf_dir):
    return bpe_chunks.token_digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_register("op7_ngram_trie")
def _op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ngram_trie.score_texts(docs, held_out("doc_id", 7, 2)).withColumnRenamed("id", "doc_id")


@_register("op8_packed_rows")
def _op8(spark, sf_dir):
    return packing.digests(packing.pack_texts(table(spark, sf_dir, "documents")))


@_register("op9_pu_quality")
def _op9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = pu_quality.fit_model(docs, labels, ~held_out("id", 3, 1))
    scored = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), pu_quality.score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@_register("op10_token_counts")
def _op10(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_rows(docs: DataFrame) -> DataFrame:
    """The runs of all documents, of which one in ten turns periodic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    planted = docs.select("doc_id", periodic_runs.plant_periods(text, F.col("doc_id")).alias("text"))
    found = periodic_runs.find_runs(planted).withColumn("longest", periodic_runs.longest_run(F.col("runs")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "longest.*",
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        periodic_runs.runs_digest(F.col("runs")).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_register("op11_periodic_runs")
def _op11(spark, sf_dir):
    return op11_rows(table(spark, sf_dir, "documents"))


@_register("op12_pivot_near_dedup")
def _op12(spark, sf_dir):
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_rows(conversations: DataFrame) -> DataFrame:
    """Faults and cheapest repair of the damaged conversations."""
    judged, repaired = conversation_repair.repair(conversation_repair.damage(conversation_repair.plain_rows(conversations)))
    digests = conversation_repair.repaired_digests(repaired).withColumnRenamed("conv", "own")
    empty = F.sha2(F.lit(""), 256)
    return judged.join(digests, F.col("conv").eqNullSafe(F.col("own")), "left").select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha256", empty).alias("repaired_sha256"),
    )


@_register("op13_conversation_repair")
def _op13(spark, sf_dir):
    return op13_rows(table(spark, sf_dir, "conversations"))
