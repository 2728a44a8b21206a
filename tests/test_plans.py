"""Plans: large groups must not meet in one task, and no join runs on a constant."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from selroute.operators import metrics as M
from selroute.operators.ordering import attach, exact_quantiles, seeded_rank
from selroute.operators.overlap import score_bleu4, score_token_f1
from selroute.operators.splits import balanced_samples, bank_split, fraction_split, shared_by_all


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=["-1", "10m"])
def joins(request, spark):
    """Plans with and without broadcasts of small tables; statistics must not depend on them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def rows(spark):
    return spark.range(4000).select(
        (F.col("id") % 2).cast("string").alias("g"), F.col("id").alias("row_id"), (F.col("id") * 7919 % 3001 / 10).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label")
    )


def test_buckets_are_exchanged_on_their_own(rows, joins):
    text = plan(M.threshold_counts(rows, ["g"], rows_per_bucket=200))
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", text)
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert any("__bucket" in w for w in windows) and any("g#" in e and "__bucket" in e for e in exchanges)
    # By the group alone only the small table of bucket totals is moved, for its running sum.
    assert [re.findall(r"([A-Za-z_]+)#", e) for e in exchanges].count(["g"]) == 1
    running = text[text.index("Window [") :]
    first = re.search(r"Exchange hashpartitioning\(([^)]*)\)", running).group(1)
    assert "__bucket" in first


def test_no_cartesian_product_and_no_join_on_a_count(rows, joins):
    items = rows.select(F.col("row_id").alias("sample_id"), F.col("g").alias("model"), F.col("label").alias("correct"))
    made = [
        shared_by_all(items, "sample_id"),
        shared_by_all(items.withColumn("task", F.col("model")), "sample_id", among=("task",)),
        seeded_rank(rows, (), 1, ["row_id"], rows_per_bucket=100),
        fraction_split(rows, 1, ["row_id"], 0.3),
        bank_split(items, rows_per_bucket=100),
        balanced_samples(rows, ["g"], ["row_id"], range(2)),
        M.coverage_curve(rows, ["g"], "row_id", rows_per_bucket=100),
    ]
    for df in made:
        text = plan(df)
        assert "CartesianProduct" not in text
        assert all("__salt" in j for j in re.findall(r"SortMergeJoin \[(__n#[^\]]*)\]", text))


def test_attach_spreads_a_key_over_salts(rows, spark):
    small = spark.createDataFrame([("0", 5), ("1", 6)], "g string, v int")
    out = attach(rows, small, ["g"], ["row_id"])
    assert out.count() == 4000 and out.where("v <> 5 + int(g)").count() == 0
    assert attach(rows, small.where("g = '0'"), ["g"], ["row_id"], "left").where("v is null").count() == 2000


@pytest.mark.parametrize("per_bucket", [1 << 20, 50])
def test_outliers_and_packed_values(spark, per_bucket):
    """One outlier and values packed near one must neither change results nor fill one bucket."""
    rows = [(i, 1 - 1e-9 * (i * 7919 % 997), i % 3 == 0) for i in range(997)] + [(2000, -1e300, False), (2001, float("inf"), True)]
    df = spark.createDataFrame(rows, "id long, score double, label boolean").withColumn("label", F.col("label").cast("int")).withColumn("g", F.lit("a"))
    got = M.auroc(df, ["g"], rows_per_bucket=per_bucket).first()
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(got.auroc - want) < 1e-12
    quantiles = exact_quantiles(df.where("id < 2000"), ["g"], "score", {"mid": 0.5}, rows_per_bucket=per_bucket).first()
    assert quantiles.mid == sorted(s for i, s, _ in rows if i < 2000)[498]


@pytest.mark.parametrize("per_bucket", [1 << 20, 100])
def test_one_score_for_all_rows_is_cut_by_digests(spark, joins, per_bucket):
    """A group of one score, and one whose commonest score holds half of the rows: ranks are right, no join on the score."""
    rows = spark.range(1500).selectExpr("CASE WHEN id % 3 = 0 THEN 'same' ELSE 'half' END AS g", "id AS row_id", "CASE WHEN id % 3 = 0 OR id % 2 = 0 THEN 0.5D ELSE CAST(id % 11 AS DOUBLE) / 10 END AS score", "CAST(id % 7 < 3 AS INT) AS label")
    curve = M.coverage_curve(rows, ["g"], "row_id", rows_per_bucket=per_bucket)
    got = sorted((r.g, r.rank, r.row_id, round(r.accuracy, 9)) for r in curve.collect())
    want = []
    for g in ("half", "same"):
        own = sorted((r for r in rows.collect() if r.g == g), key=lambda r: (-r.score, hashlib.md5(f"tie-{r.row_id}".encode()).hexdigest()))
        hits = 0
        for k, r in enumerate(own, 1):
            hits += r.label
            want.append((g, k, r.row_id, round(hits / k, 9)))
    assert got == want
    if per_bucket == 100:
        text = plan(curve)
        windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", text)
        assert any("__bucket" in w for w in windows)
        assert not re.search(r"Join \[g#\d+, score#", text)


def test_the_input_of_running_totals_is_read_once(spark, tmp_path):
    spark.range(3000).selectExpr("CAST(id % 2 AS STRING) AS g", "CAST(id * 7919 % 2003 AS DOUBLE) AS score", "CAST(id % 3 = 0 AS INT) AS label").write.parquet(str(tmp_path / "in"))
    seen = spark.sparkContext.accumulator(0)
    import pyarrow as pa  # counts the rows that pass

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)

    rows = spark.read.parquet(str(tmp_path / "in")).mapInArrow(count, "g string, score double, label int")
    for per_bucket in (1 << 20, 200):
        before = seen.value
        M.threshold_counts(rows, ["g"], rows_per_bucket=per_bucket).collect()
        assert seen.value - before == 3000


def test_text_scores_stay_in_their_rows(spark):
    df = spark.createDataFrame([(1, "a cat sat", "a cat sat"), (1, "dog", "cat"), (2, "", ""), (3, None, "x")], "row_id long, pred string, ref string")
    for scored in (score_token_f1(df, "row_id"), score_bleu4(df, "row_id")):
        assert "Exchange" not in plan(scored)
    assert sorted(map(tuple, score_token_f1(df, "row_id").collect())) == [(1, 0.0), (1, 1.0), (2, 1.0)]
