"""Best thresholds on repeated balanced draws, against drawing every sample."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from selroute.operators import agreement as A
from selroute.operators import repeats as B


def slow_sweeps(rows, seeds):
    """{(group, seed): (threshold, accuracy)}."""
    out = {}
    for g in {r[0] for r in rows if r[0] is not None}:
        own = [r for r in rows if r[0] == g and r[2] is not None]
        classes = {}
        for r in own:
            classes.setdefault(r[2], []).append(r)
        k = min(map(len, classes.values()))
        for seed in seeds:
            order = lambda r: hashlib.md5(f"{seed}-{r[1]}".encode()).hexdigest()
            drawn = [r for c in classes.values() for r in sorted(c, key=order)[:k] if r[3] is not None]
            best = max(
                ((sum((r[3] >= t) == (r[2] == 1) for r in drawn), -t) for t in {r[3] for r in drawn}), default=None
            )
            if best:
                out[g, seed] = (-best[1], best[0] / len(drawn))
    return out


def table(seed, n=260):
    rng = random.Random(seed)
    rows = [("a", i, int(rng.random() < 0.25), round(rng.gauss(0, 1), 1)) for i in range(n)]
    rows += [("b", i, int(rng.random() < 0.7), float(i % 4 == 0) if rng.random() < 0.6 else rng.random()) for i in range(n)]  # two frequent values
    rows += [("c", i, 1, rng.random()) for i in range(20)] + [("d", 1, 0, 0.5), ("d", 2, 1, 0.5), ("e", 1, 0, None), ("e", 2, 1, 2.0)]
    rows += [("a", 1000, None, 0.3), ("a", 1001, 1, None), (None, 1, 1, 0.1)]
    return rows


SCHEMA = "metric string, doc_id int, label int, value double"


@pytest.mark.parametrize("rows_per_bucket", [B.ROWS_PER_BUCKET, 40])
@pytest.mark.parametrize("seeds", [range(30), [42], [7, 3, 100]])
def test_sweeps_equal_brute_force(spark, rows_per_bucket, seeds):
    rows = table(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = B.balanced_sweeps(df, ["metric"], ["doc_id"], seeds, rows_per_bucket=rows_per_bucket).collect()
    want = slow_sweeps(rows, seeds)
    assert {(r.metric, r.seed): (r.threshold, pytest.approx(r.accuracy)) for r in got} == want


def test_a_window_that_misses_is_widened(spark, monkeypatch):
    """With a margin of nearly nothing the first windows miss the last digest; the result is the same."""
    rows = table(4)
    calls = []
    cuts = B._cuts
    monkeypatch.setattr(B, "_cuts", lambda drawn, keys, seeds, margin=1e-3: calls.append(margin) or cuts(drawn, keys, seeds, margin))
    got = B.balanced_sweeps(spark.createDataFrame(rows, SCHEMA), ["metric"], ["doc_id"], range(40)).collect()
    assert {(r.metric, r.seed): (r.threshold, pytest.approx(r.accuracy)) for r in got} == slow_sweeps(rows, range(40))
    assert len(calls) > 1 and calls[1] == 8e-3


def test_small_buffers_and_steps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(B, "_CELLS", 64)
    monkeypatch.setattr(B, "_BUFFER", 50)
    rows = table(5, 90)
    got = B.balanced_sweeps(spark.createDataFrame(rows, SCHEMA), ["metric"], ["doc_id"], range(8)).collect()
    assert {(r.metric, r.seed): (r.threshold, pytest.approx(r.accuracy)) for r in got} == slow_sweeps(rows, range(8))


def test_repeats_are_summed_up_and_empty_tables(spark):
    rows = table(2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.metric: r for r in A.balanced_accuracy(df, ["metric"], ["doc_id"], 20).collect()}
    want = slow_sweeps(rows, range(20))
    own = [v for (g, _), v in want.items() if g == "a"]
    assert got["a"].bal_acc == pytest.approx(np.mean([a for _, a in own])) and got["a"].threshold_std == pytest.approx(np.std([t for t, _ in own]))
    assert B.balanced_sweeps(df.limit(0), ["metric"], ["doc_id"], range(5)).count() == 0
    whole = df.where("metric = 'a'").drop("metric")
    assert B.balanced_sweeps(whole, [], ["doc_id"], range(5)).count() == 5


def test_nothing_of_rows_times_seeds_is_written_or_moved(spark, monkeypatch):
    """600 seeds over 3,000 rows: what is written and what is exchanged stay far below 1.8 million rows."""
    written = []
    durable = B.durable
    monkeypatch.setattr(B, "durable", lambda df: written.append(durable(df)) or written[-1])
    df = spark.range(3000).selectExpr("'m' AS metric", "id AS doc_id", "CAST(id % 10 < 2 AS INT) AS label", "CAST(id * 7919 % 1009 AS DOUBLE) AS value")
    out = B.balanced_sweeps(df, ["metric"], ["doc_id"], range(600))
    assert out.count() == 600 and sum(t.count() for t in written) <= 2 + 2 * 600
    text = out._jdf.queryExecution().executedPlan().toString()
    moved = text[: text.index("MapInArrow")] if "MapInArrow" in text else text
    assert "Generate explode" not in moved


def test_digests_of_one_block_are_computed_side_by_side(monkeypatch):
    md5, alone = hashlib.md5, []
    monkeypatch.setattr(B.hashlib, "md5", lambda m: alone.append(len(m)) or md5(m))
    ids, seeds = ["", "7", "12-345", "é" * 20, *["x" * n for n in (49, 50, 51, 52, 53, 54, 55, 64, 200)]], [7, 3, 100, -5, 123456]
    found = B.digests(ids, seeds)
    assert alone and min(alone) > 55  # only messages of more than one block
    want = [[md5(f"{s}-{i}".encode()).digest() for s in seeds] for i in ids]
    assert [[w.astype(">u8").tobytes() for w in row] for row in found] == want


def test_an_id_is_digested_once_for_all_its_groups(monkeypatch):
    calls, digests = [], B.digests
    monkeypatch.setattr(B, "digests", lambda ids, seeds: calls.extend(ids) or digests(ids, seeds))
    ids = [str(i // 3) for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"metric": ["a", "b", "c"] * 100, "__class": [1] * 300, "__size": [100] * 300, "__take": [40] * 300, "__id": ids})
    schema = pa.schema([("metric", pa.string()), ("__class", pa.int64()), ("seed", pa.int64()), ("below", pa.int64()), ("inside", pa.list_(pa.binary()))])
    rows = [r for b in B._count_below(["metric"], [5, 42], 1.0, schema)(iter([batch])) for r in b.to_pylist()]
    assert sorted(calls) == sorted(set(ids))
    first, last = B._window(100, 40, 1.0)
    for r in rows:
        own = [hashlib.md5(f"{r['seed']}-{i}".encode()).digest() for i in set(ids)]
        lead = [int.from_bytes(d[:8]) for d in own]
        assert r["below"] == sum(x < first for x in lead)
        assert sorted(r["inside"]) == sorted(d for d, x in zip(own, lead, strict=True) if first <= x <= last)
    assert {(r["metric"], r["seed"]) for r in rows} == {(m, s) for m in "abc" for s in (5, 42)}
