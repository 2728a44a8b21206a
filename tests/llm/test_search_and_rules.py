import math
import re
from collections import Counter

from pyspark.sql import functions as F

from selroute.llm import decontaminate, url_filter
from selroute.llm.queries import URL_RULES


def slow_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m.group(1)), m.group(2)) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules_match_brute_force(spark):
    hosts = ["example.net", "A.Example.NET", "net", "xnet", "b.org", "org", "www.example.com", "example.com.", "", "a..net", "example.net:80", "com", "é.net"]
    paths = ["", "/", "/en/", "/en/x", "/en", "/EN/x", "/de/a?b", "/fr/#x", "?q=/en/", "#/en/", "/fr/x://y"]
    urls = [f"{s}{h}{p}" for s in ("http://", "://", "") for h in hosts for p in paths] + [None, "", "x://", "http://a.net/en/\nb"]
    rows = list(enumerate(urls)) + [(7, urls[7]), (None, "http://a.net/"), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    many = [*URL_RULES, ("net", "/en/", "block"), ("net", "/", "allow"), ("a.example.net", "", "block"), ("", "/", "block")]
    for rules in (list(URL_RULES), many, []):
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        known = {}
        for h, p, v in rules:  # of equal rules "block" wins
            known[(h, p)] = max(v, known.get((h, p), ""))
        flat = [(h, p, v) for (h, p), v in known.items()]
        for parts in (1, 5, 200):
            got = url_filter.judge_urls(pages, table, parts=parts).collect()
            assert Counter((r.id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i, *slow_verdict(u, flat)) for i, u in rows)
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0


def test_boundaries_spread_a_host_and_repeat_its_rules(spark):
    """A third of all urls on one host: it takes a third of the parts, and nested rules fit in all of them."""
    rows = [(i, "http://www.hot.example.net/en/" + str(i) if i % 3 == 0 else f"http://h{i}.org/fr/{i}") for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    keys = pages.select(F.col("page_id").alias("id"), host.alias("host"), path.alias("path")).withColumn("key", url_filter.host_key(F.col("host")))
    cuts = url_filter.boundaries(keys, 30)
    assert len(cuts) == 29 and cuts == sorted(cuts) and 9 <= cuts.count(b"net.example.hot.www.") <= 11
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("www.hot.example.net", "/en/1", "block"), ("org", "/fr/1", "block"), ("h7.org", "", "allow")]
    judged = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), parts=30)
    assert Counter((r.id, r.host, r.path, r.rule, r.verdict) for r in judged.collect()) == Counter((i, *slow_verdict(u, rules)) for i, u in rows)
    plan = judged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(part") == 1  # urls move once


def plain(text):
    return re.sub(r"[\x00-\x7f]", lambda m: m.group().lower() if m.group().isalnum() else " ", text or "").split(" ")


def shingles(text, width):
    w = [x for x in plain(text) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def slow_hits(docs, items):
    out = Counter()
    for item, text in items:
        n = len([x for x in plain(text) if x])
        if not n:
            continue
        want = shingles(text, min(5, n))
        for doc, body, *_ in docs:
            shared = len(want & shingles(body, min(5, n)))
            if shared >= 0.8 * len(want) - 1e-9:
                out[(doc, item, shared, len(want))] += 1
    return out


def test_containment_matches_brute_force(spark, messy, messy_rows, crowded, nothing):
    long = next(t for d, t, *_ in messy_rows if d == 304).split()
    passage = long[14_000:14_040]
    items = [(1, " ".join(passage)), (2, " ".join(passage[:36] + ["other"] * 4)), (3, " ".join(passage[:30] + ["odd"] * 10)), (4, "The river, of"), (5, None)]
    items += [(6, ""), (7, messy_rows[5][1].replace("river", "RIVER").replace("the", "The")), (8, " ".join(long[100:104])), (1, " ".join(passage)), (9, "nothing like it in any of these texts")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = slow_hits(messy_rows, items)
    assert {i for _, i, *_ in want} >= {1, 2, 7, 8} and not any(i in (5, 6, 9) for _, i, *_ in want)
    for options in ({}, {"block_items": 3}):
        got = decontaminate.contaminated(messy, table, **options).collect()
        assert Counter((r.id, r.item_id, r.n_shared, r.n_item) for r in got) == want
    kept = decontaminate.decontaminate(crowded, table)
    assert kept.columns == crowded.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, *_ in messy_rows if not any(x == d for x, *_ in want))
    assert decontaminate.contaminated(nothing, table).count() == 0
    assert decontaminate.decontaminate(messy, table.limit(0)).count() == len(messy_rows)


def test_sketch_is_large_enough_for_every_size():
    """Of n shingles, fewer than what the sketch leaves out can be missing from a hit."""
    for n in range(1, 200):
        largest = (1 << n.bit_length()) - 1
        keep = min(n, largest - decontaminate.needed(largest, 0.8) + 1)
        assert keep >= n - decontaminate.needed(n, 0.8) + 1 and decontaminate.needed(n, 0.8) >= math.ceil(0.8 * n - 1e-6)
