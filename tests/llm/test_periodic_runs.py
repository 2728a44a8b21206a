import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from selroute.llm import periodic_runs
from selroute.llm.queries import op11_rows


def slow_runs(words):
    """All maximal stretches, by every period and start."""
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def planted(text, doc_id):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def slow_row(doc_id, text):
    words = planted(text, doc_id)
    runs = slow_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = best[1] * 1000 // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def random_text(rng):
    kind = rng.randrange(6)
    if kind == 0:  # few words: many runs
        return [rng.choice("ab") for _ in range(rng.randrange(0, 300))]
    if kind == 1:
        return [rng.choice("abc")] * rng.randrange(0, 60)
    out = []
    for _ in range(rng.randrange(1, 6)):  # stretches of long periods, some of them periodic inside
        period = [rng.choice("abcdef") if kind == 2 else f"w{rng.randrange(1000)}" for _ in range(rng.choice((1, 2, 3, 7, 8, 9, 16, 31, 45, 64, 100)))]
        if kind == 3:
            period = ["a"] * rng.randrange(1, 70) + ["b"] * rng.randrange(1, 5)
        if kind == 4:
            period = (period * rng.randrange(1, 6)) + ["x"]
        n = rng.randrange(1, 7 * len(period))
        out += (period * 7)[:n]
    return out


def test_runs_equal_brute_force_in_blocks_of_texts():
    rng = random.Random(4)
    texts = [random_text(rng) for _ in range(700)]
    for size in (1, 50, 700):
        for i in range(0, 700 if size > 1 else 100, size):
            part = texts[i : i + size]
            got = periodic_runs.find_in_texts([" ".join(t).encode() for t in part])
            for t, (runs, collapsed) in zip(part, got, strict=True):
                assert runs == slow_runs(t)
                gone = {j for s, m, q in runs for j in range(s + q, s + m)}
                assert collapsed.decode().split() == [w for j, w in enumerate(t) if j not in gone]


def test_a_hash_that_lies_is_found_out(monkeypatch):
    """With a hash of one value for all stretches every extension is wrong, and still all runs come out right."""
    rng = random.Random(6)
    texts = [random_text(rng)[:160] for _ in range(60)]
    monkeypatch.setattr(periodic_runs._Prefix, "same", lambda self, a, b, size: size >= 0)
    for t in texts:
        got = periodic_runs.find_in_texts([" ".join(t).encode()])[0][0]
        assert got == slow_runs(t)


def test_words_of_one_kind_and_long_periods_take_few_seeds():
    import numpy as np

    counted = []
    seeds = periodic_runs._seeds
    periodic_runs._seeds = lambda h, scale: counted.append(len((found := seeds(h, scale))[0])) or found
    try:
        text = ["a"] * 50_000 + ["b"] + (["a"] * 700 + ["b"]) * 60 + [f"w{i % 9000}" for i in range(45_000)]
        runs = periodic_runs.find_in_texts([" ".join(text).encode()])[0][0]
    finally:
        periodic_runs._seeds = seeds
    assert {q for _, _, q in runs} == {1, 701, 9000} and sum(counted) < len(text) / 4
    assert np.all([m >= 4 * q for _, m, q in runs])


def test_rows_match_brute_force_on_messy_tables(spark, messy, crowded, messy_rows, nothing):
    rng = random.Random(1)
    more = [(1000 + i, " ".join(random_text(rng)), "en", "s", 0) for i in range(150)]
    docs = messy.unionByName(spark.createDataFrame(more, messy.schema))
    want = Counter(slow_row(d, t) for d, t, *_ in [*messy_rows, *more] if not t or len(t) < 50_000)
    got = op11_rows(docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r for r in map(tuple, got.collect())}
    assert {r for r in rows if r[0] not in (304, 305)} == set(want) and got.count() == docs.count()
    assert set(map(tuple, op11_rows(crowded).collect())) == set(map(tuple, op11_rows(messy).collect()))
    assert op11_rows(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 11, 60])
def test_planting_follows_the_ids(spark, n):
    text = " ".join(f"w{i}" for i in range(n)) + "\n"
    rows = spark.createDataFrame([(i, text) for i in range(120)], "doc_id long, text string")
    got = rows.select("doc_id", periodic_runs.plant_periods(F.col("text"), F.col("doc_id")).alias("t")).collect()
    assert all(r.t.encode().split() == planted(text, r.doc_id) for r in got)
