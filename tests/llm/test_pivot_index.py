from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from selroute.llm import pivot_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def cosine(a, b):
    a, b = (np.asarray(x, np.float64) for x in (a, b))
    return a @ b / np.sqrt((a @ a) * (b @ b))


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.9):
    """(id, n_links, component_id) of every row, by comparing all."""
    n = len(rows)
    good = [usable(r[1]) for r in rows]
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    degree = [0] * n
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]) and cosine(np.float32(rows[i][1]), np.float32(rows[j][1])) >= threshold:
                degree[i] += 1
                degree[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], degree[i], least.get(find(i))) for i in range(n)]


def near(v, c, rng):
    z = rng.normal(size=len(v))
    z -= (z @ v) * v
    return c * v + np.sqrt(1 - c * c) * z / np.linalg.norm(z)


def clustered(seed=0, d=48):
    """Singles, pairs, chains, and one dense group; cosines well off the threshold."""
    rng = np.random.default_rng(seed)
    unit = lambda: (lambda x: x / np.linalg.norm(x))(rng.normal(size=d))
    out = [unit() for _ in range(200)]
    for v in list(out[:60]):
        out.append(near(v, 0.95, rng))
    for v in list(out[60:100]):
        out.append(near(v, 0.85, rng))
    chain = unit()
    for _ in range(12):
        out.append(chain)
        chain = near(chain, 0.94, rng)
    centre = unit()
    out += [near(centre, 0.985, rng) for _ in range(80)]
    return [(i, [float(x) for x in v], 0) for i, v in enumerate(out)]


@pytest.fixture(scope="module")
def odd():
    nan, inf = float("nan"), float("inf")
    rows = clustered()
    copies = [(1000 + i, rows[5][1], 1) for i in range(30)] + [(5, rows[5][1], None), (None, rows[5][1], 2), (None, rows[150][1], 2)]
    bad = [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 48, 0), (2003, [nan] * 48, 0), (2004, [inf] + [1.0] * 47, 0), (2005, [None] + [1.0] * 47, 0)]
    scaled = [(3000, [x * 1e-20 for x in rows[7][1]], 0), (3001, [x * 1e18 for x in rows[8][1]], 0), (3002, [1.0, 2.0], 0), (3003, [2.0, 4.0], 0), (None, None, None)]
    return rows + copies + bad + scaled


def as_rows(df):
    got = df.collect()
    assert all(r.kept == (r.id == r.component_id) for r in got)
    return Counter((r.id, r.n_links, r.component_id) for r in got)


@pytest.mark.parametrize("list_rows", [pivot_index.LIST_ROWS, 12])
def test_links_equal_brute_force_also_in_cut_lists(spark, odd, monkeypatch, list_rows):
    monkeypatch.setattr(pivot_index, "LIST_ROWS", list_rows)
    table = spark.createDataFrame(odd, SCHEMA).repartition(3)
    want, got = Counter(brute(odd)), as_rows(pivot_index.near_vectors(table))
    assert sum((want - got).values()) <= 0.02 * len(odd) and sum(got.values()) == len(odd)
    exact = {i: (n, c) for i, n, c in brute(odd) if i is not None}
    assert all(n <= exact[i][0] and c >= exact[i][1] for i, n, c in got if i is not None)  # never a link too many


def test_result_does_not_depend_on_cuts_copies_or_clashing_names(spark, odd, monkeypatch):
    table = spark.createDataFrame(odd, SCHEMA)
    want = as_rows(pivot_index.near_vectors(table.repartition(2)))
    names = ("id", "node", "vector", "list", "block", "pivots", "copies", "partners", "root", "least", "h", "v")
    crowded = table.repartition(5).withColumns({n: F.lit(f"own {n}") for n in names})
    monkeypatch.setattr(pivot_index, "LIST_ROWS", 9)
    assert as_rows(pivot_index.near_vectors(crowded)) == want


def test_empty_and_unusable_tables(spark):
    assert pivot_index.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (None, [float("nan")], 0)]
    assert as_rows(pivot_index.near_vectors(spark.createDataFrame(rows, SCHEMA))) == Counter([(1, 0, 1), (2, 0, 2), (None, 0, None)])
    doubles = spark.createDataFrame([(1, [3.0, 4.0]), (2, [6.0, 8.0]), (3, [4.0, -3.0])], "vec_id long, embedding array<double>")
    assert as_rows(pivot_index.near_vectors(doubles)) == Counter([(1, 1, 1), (2, 1, 1), (3, 0, 3)])


@pytest.mark.parametrize(("rows", "pivots"), [(10_000, 256), (50_000, 512), (4_000_000, 4096)])
def test_recall_at_the_threshold_by_size_of_table(rows, pivots):
    """Pairs of cosine 0.9, the worst case, in 64 dimensions: how many share a list and enough pivots."""
    assert pivot_index.pivots_for(rows) == pivots
    rng = np.random.default_rng(3)
    x, z, points = (rng.normal(size=(n, 64)) for n in (2000, 2000, pivots))
    x, points = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (x, points))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (pivot_index.nearest_pivots(u, points) for u in (x, y))
    lists = pivot_index.lists_for(pivots)
    meet = (a[:, :lists, None] == b[:, None, :lists]).any(axis=(1, 2))
    shared = (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2))
    recall = (meet & (shared >= pivot_index.SHARED)).mean()
    print(f"{rows} rows, {pivots} pivots, {lists} lists: recall {recall:.3f}")
    assert recall >= 0.92


def test_shared_counts_equal_set_intersections():
    rng = np.random.default_rng(5)
    near_ = np.array([rng.choice(130, 12, replace=False) for _ in range(40)])
    bits = np.zeros((40, 3), np.uint64)
    for i, row in enumerate(near_):
        for p in row:
            bits[i, p >> 6] |= np.uint64(1 << (int(p) & 63))
    got = np.concatenate([pivot_index.shared_counts(bits, slice(a, a + 16)) for a in (0, 16, 32)])
    assert (got == [[len(set(a) & set(b)) for b in near_] for a in near_]).all()
