"""Host and path rules as a sort-merge range join.

A rule (host, path) covers its host, all subdomains, and every path that starts with its path. A host's labels reversed, with a dot
behind each, are its canonical key: the hosts a rule covers are the keys that start with the rule's own, an interval. Urls and the
starts of these intervals are sorted together by key, once; a sweep keeps the stack of host rules whose intervals are open (a rule
ends where a key no longer starts with it), each with its paths, and asks all of them for the longest path the url starts with.

The sort is a range partitioning of its own: a sample of about ``SAMPLE`` keys gives the boundaries, a host that holds several of
them spreads over the parts between, and the rules of a host are repeated in all parts that its interval meets. So a host with any
share of all urls is dealt to many tasks, every url moves once whatever its number of labels, and no table is broadcast. Boundaries
change where work is done, never a result.

Defined cases: a null url, or one without "://", has an empty host and path; a rule's path is matched literally; of equal
(host, path) rules "block" wins; the longest rule (characters of host and path) wins, then the longer host; repeated rows
are returned as often as they came; an empty rule table leaves every verdict to ``default``; an empty table gives an empty result;
a host of any length is one key; only id and url are read, so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
PARTS_PER_PARTITION = 4
_AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_JUDGED = "id long, host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _AFTER_SCHEME, 1), _UPPER, _LOWER), F.regexp_extract(url, _AFTER_SCHEME, 2)


def host_key(host: Column) -> Column:
    """Labels from the last to the first, a dot behind each."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def boundaries(keys: DataFrame, parts: int) -> list[bytes]:
    """Keys that cut the rows of ``keys`` (id, host, path, key) into about equal parts; a frequent key may occur several times."""
    every = max(1, keys.count() // SAMPLE)
    sample = keys.filter(F.pmod(F.xxhash64("id", "host", "path"), F.lit(every)) == 0).groupBy("key").agg(F.count("*").alias("n")).collect()
    counted = sorted((r["key"].encode(), r["n"]) for r in sample)
    total, out, seen = sum(n for _, n in counted), [], 0
    for key, n in counted:
        seen += n
        while len(out) < parts - 1 and seen * parts > (len(out) + 1) * total:
            out.append(key)
    return out


def _places(cuts: list[bytes]):
    """Arrow function: first and last part that a key, or any key that starts with it, may be in."""

    def place(keys: pa.Array, prefix: pa.Array) -> pa.Array:
        found = [
            (bisect_left(cuts, k := key.encode()), bisect_right(cuts, k + b"\xff" if wide else k))
            for key, wide in zip(keys.to_pylist(), prefix.to_pylist(), strict=True)
        ]
        first, last = zip(*found, strict=True) if found else ((), ())
        return pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["first", "last"])

    place.__annotations__ = {"keys": pa.Array, "prefix": pa.Array, "return": pa.Array}
    return F.arrow_udf(place, "struct<first:int,last:int>")


class _HostRules:
    """The rules of one host: paths by length, longest first."""

    def __init__(self, key: str, host: str, rules: list[dict]):
        self.key, self.host = key, host
        self.verdicts = {r["path"]: r["verdict"] for r in rules}
        self.lengths = sorted({len(p) for p in self.verdicts}, reverse=True)

    def fit(self, path: str) -> tuple[int, int, str, str] | None:
        for n in self.lengths:
            if n <= len(path) and (verdict := self.verdicts.get(path[:n])) is not None:
                return len(self.host) + n, len(self.host), self.host + path[:n], verdict
        return None


def _sweep(default: str):
    schema = pa.schema([("id", pa.int64()), *[(c, pa.string()) for c in ("host", "path", "rule", "verdict")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (part, key, rules first); the stack is carried from batch to batch."""
        stack: list[_HostRules] = []
        part = None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for here, key, id_, host, path, rules in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "id", "host", "path", "rules")), strict=True):
                if here != part:
                    stack, part = [], here
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if rules is not None:
                    stack.append(_HostRules(key, host, rules))
                    continue
                best = max(filter(None, (open_.fit(path) for open_ in stack)), default=(0, 0, None, default))
                for column, value in zip(out, (id_, host, path, *best[2:]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", parts: int | None = None
) -> DataFrame:
    """Return id, host, path, rule (null where none fits) and verdict for every row of ``pages``.

    ``rules`` has the columns host, path and verdict. ``parts`` is the number of ranges (by default some per shuffle partition).
    """
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    place = _places(boundaries(urls, parts or PARTS_PER_PARTITION * partitions))
    shape = "array<struct<path:string,verdict:string>>"
    spread = F.pmod(F.xxhash64("id", "path"), F.col("at.last") - F.col("at.first") + 1).cast("int")
    asked = urls.withColumn("at", place("key", F.lit(False))).select(
        (F.col("at.first") + spread).alias("part"), "key", "id", "host", "path", F.lit(None).cast(shape).alias("rules")
    )
    known = rules.select(
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    by_host = known.groupBy("host").agg(F.collect_list(F.struct("path", "verdict")).alias("rules")).withColumn("key", host_key(F.col("host")))
    starts = by_host.withColumn("at", place("key", F.lit(True))).select(
        F.explode(F.sequence("at.first", "at.last")).alias("part"), "key", F.lit(None).cast("long").alias("id"), "host",
        F.lit(None).cast("string").alias("path"), "rules",
    )
    ordered = starts.unionByName(asked).repartition(partitions, "part").sortWithinPartitions("part", "key", F.col("rules").isNull())
    return ordered.mapInArrow(_sweep(default), _JUDGED)
