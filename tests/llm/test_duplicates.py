import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from selroute.llm import components, exact_dedup, simhash_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups_match_brute_force(messy, messy_rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in messy_rows:
        groups[normal(text)].append((-len(text or ""), doc_id is None, doc_id or 0))
    want = Counter()
    for doc_id, text, *_ in messy_rows:
        best = min(groups[normal(text)])
        keep = None if best[1] else best[2]
        want[(doc_id, keep, len(groups[normal(text)]), doc_id == keep, hashlib.sha256(normal(text).encode()).hexdigest())] += 1
    for max_bits in (exact_dedup.MAX_BITS, 1 << 16):
        got = exact_dedup.exact_groups(messy, max_bits=max_bits).collect()
        assert Counter((r.id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got) == want


def test_only_possible_copies_are_shuffled(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 50, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    keyed = docs.select(exact_dedup._digest("text").alias("digest"))
    bits = exact_dedup.filter_bits(5000)
    marked = exact_dedup.with_suspicion(keyed, "digest", exact_dedup.slot_bitmap(keyed, bits), bits, "suspect")
    suspects = marked.filter("suspect").count()
    assert 50 <= suspects < 50 + 5000 * 0.05


def test_deduplicate_keeps_one_row_of_each_group_and_all_columns(crowded, messy_rows, nothing):
    out = exact_dedup.deduplicate(crowded)
    assert out.columns == crowded.columns
    rows = out.collect()
    assert len(rows) == len({normal(t) for _, t, *_ in messy_rows}) and all(r.digest == "own digest" for r in rows)
    assert Counter(normal(r.text) for r in rows).most_common(1)[0][1] == 1
    assert exact_dedup.deduplicate(nothing).count() == 0 and exact_dedup.exact_groups(nothing).count() == 0


def test_exact_dedup_runs_no_python(messy):
    plan = exact_dedup.deduplicate(messy)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def slow_fingerprint(text, words=4):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def closure(prints, max_bits):
    least = {}
    for doc_id, p in prints:
        least[p] = min((x for x in (least.get(p), doc_id) if x is not None), default=None)
    group = {p: p for p in least}

    def find(p):
        while group[p] != p:
            p = group[p]
        return p

    for a in least:
        for b in least:
            if a < b and (a ^ b).bit_count() <= max_bits and find(a) != find(b):
                group[find(b)] = find(a)
    best = {}
    for p, i in least.items():
        r = find(p)
        best[r] = min((x for x in (best.get(r), i) if x is not None), default=None)
    return {p: best[find(p)] for p in least}


def test_hamming_groups_match_brute_force(messy, messy_rows, nothing):
    prints = [(d, slow_fingerprint(t)) for d, t, *_ in messy_rows]
    want = closure(prints, 4)
    got = simhash_dedup.hamming_groups(messy).collect()
    assert Counter((r.id, r.fingerprint % 2**64, r.component_id) for r in got) == Counter((d, p, want[p]) for d, p in prints)
    assert simhash_dedup.hamming_groups(nothing).count() == 0


def test_spark_and_python_agree_on_the_hash(spark):
    text = "a shingle of wörds that is longer than thirty-two bytes"
    assert spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_no_link_is_lost_in_dense_and_cut_cells(spark, monkeypatch):
    """Chains and clouds of close fingerprints, with cells so small that they are cut into blocks."""
    monkeypatch.setattr(simhash_dedup, "CELL_ROWS", 8)
    rng = np.random.default_rng(3)
    values = []
    for _ in range(6):
        x = int(rng.integers(0, 2**63))
        for _ in range(40):
            values.append(x)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
    values += [int(v) for v in rng.integers(0, 2**63, 300)]
    prints = list(enumerate(values))
    table = spark.createDataFrame([(i, v.to_bytes(8, "little")) for i, v in prints], "id long, print binary")
    distinct = table.select("print").distinct()
    for bands in (6, 7):
        links = simhash_dedup._link(distinct, simhash_dedup.popcount_cells(bands, 4), 1, 4, True)
        rows = {int.from_bytes(r["print"], "little"): r.component_id for r in simhash_dedup._classes(table, links).collect()}
        assert rows == closure(prints, 4)


def test_popcount_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2, (500, 64), dtype=np.uint8) for _ in range(2))
    bound = np.abs(simhash_dedup.segment_counts(a).astype(int) - simhash_dedup.segment_counts(b)).sum(1)
    assert (bound <= (a != b).sum(1)).all()


def test_keep_one_of_each_group_in_whole_rows(crowded, messy_rows, nothing):
    """The smallest id of every brute-force group stays, with all columns of the row; rows without an id stay."""
    prints = [(d, slow_fingerprint(t)) for d, t, *_ in messy_rows]
    groups = closure(prints, 4)
    out = simhash_dedup.keep_one(crowded)
    assert out.columns == crowded.columns
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, p in prints if d is None or groups[p] == d)
    assert all(r.digest == "own digest" and r.key == "own key" for r in rows)
    assert simhash_dedup.keep_one(nothing).count() == 0


def test_an_id_with_two_texts_loses_only_the_copy(spark):
    text = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"v{i}" for i in range(300))
    rows = [(5, text.upper()), (5, other), (3, text), (7, text), (7, text)]
    out = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(5, other), (3, text)])


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(201, 202), (202, 203), (203, 201), (300, 300)]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r.node: r.root for r in rows}
    assert len(rows) == len(got)
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and {got[i] for i in (201, 202, 203)} == {201}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
