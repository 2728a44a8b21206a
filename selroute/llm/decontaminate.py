"""Benchmark decontamination: containment search for short test items inside documents of any length.

Items are partitioned by their number of distinct shingles. Each partition keeps, per item, its smallest MinHash values: so many
that an item with at least ``threshold`` of its shingles in a document must share one of them (n - ceil(threshold * n) + 1
values of n). The set of these values is the index; every shingle of a whole document is looked up in it, and an item that is
hit becomes a candidate. A candidate counts by its exact containment: the share of its distinct shingles, as text, that the
document has. No document is sketched or cut, so length costs no recall.

Items are sent to the tasks in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters, which bounds what is
broadcast; a larger benchmark takes more passes over the documents.

Words are runs of characters other than ASCII punctuation and white space, with A-Z in lower case; a shingle is five words, or
the whole item where it has fewer. Defined cases: null and empty texts match nothing; repeated items give a row each; repeated
documents are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selroute.llm.common import blocks, find_words, hash_windows, hash_words, raw_texts

WORDS = 5
THRESHOLD = 0.8
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 16 << 20
# Letters, digits and every byte above ASCII stay; the rest of ASCII becomes a blank.
_PLAIN = bytes(32 if i < 128 and not chr(i).isalnum() else i + 32 if 65 <= i <= 90 else i for i in range(256))
HITS = "array<struct<item_id:bigint,n_shared:int,n_item:int,containment:double>>"


def needed(n: int, threshold: float) -> int:
    """How many of n shingles make up the threshold."""
    return max(1, math.ceil(threshold * n - 1e-9))


class ItemIndex:
    """Sketches of one block of items, by size partition, and the items' shingles for the exact check."""

    def __init__(self, items: list[tuple[int, bytes]], words: int = WORDS, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.ids, self.sizes, self.shingles, self.partition = [], [], [], []
        by_width: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            found = text.translate(_PLAIN).split()
            if not found:
                continue
            width = min(words, len(found))
            distinct = {b" ".join(found[i : i + width]) for i in range(len(found) - width + 1)}
            values = np.sort(np.fromiter((_shingle_hash(s) for s in distinct), np.uint64, count=len(distinct)))
            n = len(self.ids)
            self.ids.append(item_id)
            self.sizes.append(len(distinct))
            self.shingles.append(distinct)
            self.partition.append(len(distinct).bit_length())
            largest = (1 << self.partition[-1]) - 1
            keep = largest - needed(largest, threshold) + 1  # enough for every item of this size partition
            by_width.setdefault(width, []).extend((int(v), n) for v in values[:keep])
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width, pairs in by_width.items():
            pairs.sort()
            values, starts = np.unique(np.array([v for v, _ in pairs], np.uint64), return_index=True)
            owners = np.array([n for _, n in pairs], np.int64)
            self.index[width] = values, np.append(starts, len(owners)), owners

    def candidates(self, texts: list[bytes]) -> dict[int, set[int]]:
        """Items that share a sketch value with a text, by the text's position."""
        out: dict[int, set[int]] = {}
        buffer, starts, lengths, owner = find_words(texts)
        words = hash_words(buffer, starts, lengths)
        for width, (values, bounds, owners) in self.index.items():
            h, first = hash_windows(words, owner, width)
            at = np.searchsorted(values, h)
            hit = np.flatnonzero(values[np.minimum(at, len(values) - 1)] == h)
            for doc, v in set(zip(owner[first[hit]].tolist(), at[hit].tolist(), strict=True)):
                out.setdefault(doc, set()).update(owners[bounds[v] : bounds[v + 1]].tolist())
        return out

    def hits(self, texts: list[bytes]) -> list[list[dict]]:
        found: list[list[dict]] = [[] for _ in texts]
        plain = [t.translate(_PLAIN) for t in texts]
        for doc, items in self.candidates(plain).items():
            words = plain[doc].split()
            have: dict[int, set[bytes]] = {}
            for n in sorted(items):
                width = next(iter(self.shingles[n])).count(b" ") + 1
                if width not in have:
                    have[width] = {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
                shared = len(self.shingles[n] & have[width])
                if shared >= needed(self.sizes[n], self.threshold):
                    found[doc].append(
                        {"item_id": self.ids[n], "n_shared": shared, "n_item": self.sizes[n], "containment": shared / self.sizes[n]}
                    )
        return found


def _shingle_hash(shingle: bytes) -> int:
    buffer, starts, lengths, owner = find_words([shingle])
    return int(hash_windows(hash_words(buffer, starts, lengths), owner, len(starts))[0][0])


def _hits(index, text: Column) -> Column:
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(
            pa.struct([("item_id", pa.int64()), ("n_shared", pa.int32()), ("n_item", pa.int32()), ("containment", pa.float64())])
        )
        for batch in batches:
            found = []
            for _, run in blocks(raw_texts(batch)):
                found += index.value.hits(run)
            yield pa.array(found, kind)

    return F.arrow_udf(look_up, HITS)(text)


def with_hits(
    docs: DataFrame, items: DataFrame, hits_col: str, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    words: int = WORDS, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with a list of the items each text contains. Rows keep their place: nothing is shuffled."""
    text = F.coalesce(F.col(item_text), F.lit(""))
    known = items.select(F.col(item_id).cast("long").alias("id"), text.alias("text"))
    n, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, math.ceil(n / block_items), math.ceil(chars / block_chars))
    result = docs.withColumn(hits_col, F.array().cast(HITS))
    for k in range(passes):
        part = known.filter(F.pmod(F.xxhash64("text", "id"), F.lit(passes)) == k).collect()  # one bounded block
        index = ItemIndex([(r["id"], r["text"].encode()) for r in part], words, threshold)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        result = result.withColumn(hits_col, F.concat(F.col(hits_col), _hits(shared, F.col(text_col))))
    return result


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and item it contains: id, item_id, n_shared, n_item, containment."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_hits(rows, items, "hits", **options).select("id", F.explode("hits").alias("hit")).select("id", "hit.*")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    name = "hits"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return with_hits(docs, items, name, text_col, **options).filter(F.size(name) == 0).drop(name)
