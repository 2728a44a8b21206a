import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "glass", "Light", "over", "Under", "café", "naïve"]) + str(rng.randrange(40)) for _ in range(n))


def near(text, rng):
    parts = text.split(" ")
    parts[rng.randrange(len(parts))] = "changed"
    return " ".join(parts)


@pytest.fixture(scope="session")
def messy_rows():
    """Texts with copies, near copies, nulls, empties, ties, repeated rows, and two very long texts."""
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randrange(1, 220)), "en", f"s{i % 3}", i) for i in range(60)]
    rows += [(100 + i, rows[5][1], "en", "s0", None) for i in range(25)]  # a large group of copies
    rows += [(200 + i, near(rows[7 + i % 3][1], rng), "en", "s1", 1) for i in range(12)]
    rows += [(300, rows[5][1].replace(" ", "\n\t "), None, None, 3), (301, None, "en", "s", 0), (302, "", "en", "s", 0), (303, " \n\t", "en", "s", 0)]
    rows += [(304, words(rng, 30_000), "en", "s", 0), (305, "x" * 200_000, "en", "s", 0), (None, "no id here at all", "en", "s", 0), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (306, "one", "en", "s", 0), (307, "two <|endoftext|> words é ﬁ 日本", "en", "s", 0)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def crowded(messy):
    """The same with columns that clash with names the operators use inside."""
    names = ("id", "digest", "suspect", "row", "hits", "print", "score", "n_tokens", "ids", "points", "root", "cell", "positive", "x", "key")
    return messy.withColumns({n: F.lit(f"own {n}") for n in names})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
