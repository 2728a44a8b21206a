"""Connected components of a link table by alternating star steps, in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selroute.session import durable

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), where root is the smallest node it is linked to, itself included.

    Every round points the larger neighbours of a node at its smallest neighbour (large star), then the smaller ones (small
    star). Rounds are written to the shared folder, so a lost executor replays one round at most. Both inputs of each join are
    written tables; a node with very many links is split by the adaptive skew join.
    """
    edges = durable(_distinct(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    seen = None
    for _ in range(MAX_ROUNDS):
        edges = durable(_small_star(durable(_large_star(edges))))
        state = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = durable(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
    # Neighbours above the node move to its smallest one.
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(moved)


def _small_star(edges: DataFrame) -> DataFrame:
    least = durable(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(moved.unionByName(least.select("u", F.col("m").alias("v"))))
