"""Columns named like those the operators use inside change nothing; empty tables give empty results."""

import numpy as np
from pyspark.sql import functions as F

from selroute.llm import decontaminate, ngram_trie, packing, pu_quality, url_filter
from selroute.llm.common import held_out

NAMES = ("id", "key", "host", "path", "rule", "verdict", "block", "part", "row", "score", "item_id", "n_shared", "containment", "kept", "salt", "base", "label", "positive", "quality", "held_out")


def crowd(df):
    return df.withColumns({n: F.lit(f"own {n}") for n in NAMES if n not in df.columns})


def same(a, b):
    return sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.collect())))


def test_url_rules(spark):
    urls = ["http://a.example.net/en/x", "https://EXAMPLE.net", "x", None, "http://b.org/fr/?q", "ftp://net/", "", "http://example.net/en/x"] * 3
    pages = spark.createDataFrame([(i % 20, u) for i, u in enumerate(urls)] + [(None, urls[0])], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    plain = url_filter.judge_urls(pages, rules)
    assert same(url_filter.judge_urls(crowd(pages), rules), plain) and plain.count() == len(urls) + 1
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_a_host_of_very_many_labels(spark):
    url = "http://" + "a." * 1500 + "example.net/en/page"
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow")], "host string, path string, verdict string")
    out = url_filter.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), rules).first()
    assert (out.rule, out.verdict) == ("example.net/en/", "allow") and len(out.host) == 3011


def test_decontamination(spark, messy, nothing):
    items = spark.createDataFrame([(1, messy.filter("doc_id = 8").first().text), (2, None), (3, "one")], "item_id long, text string")
    plain = decontaminate.contaminated(messy, items)
    assert plain.count() > 0 and same(decontaminate.contaminated(crowd(messy), crowd(items)), plain)
    kept = decontaminate.decontaminate(crowd(messy), items)
    assert kept.columns == crowd(messy).columns and kept.filter("kept <> 'own kept'").count() == 0
    assert decontaminate.contaminated(nothing, items).count() == decontaminate.contaminated(messy, items.limit(0)).count() == 0


def test_packing(messy, nothing):
    one = messy.coalesce(1)
    assert same(packing.pack_texts(crowd(one), capacity=64), packing.pack_texts(one, capacity=64))
    assert packing.pack_texts(nothing).count() == 0


def test_scores_and_quality(spark, messy):
    plain = ngram_trie.score_texts(messy, held_out("doc_id", 7, 2)).collect()
    clashing = ngram_trie.score_texts(crowd(messy), held_out("doc_id", 7, 2)).collect()
    a, b = (sorted(((str(r.id), r.n_tokens, r.n_known), r.score) for r in rows) for rows in (plain, clashing))
    assert [k for k, _ in a] == [k for k, _ in b] and np.allclose([x for _, x in a], [x for _, x in b])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    models = [pu_quality.fit_model(d, x, ~held_out("id", 3, 1)) for d, x in ((messy, labels), (crowd(messy), crowd(labels)))]
    assert np.allclose(models[0].weights, models[1].weights)
