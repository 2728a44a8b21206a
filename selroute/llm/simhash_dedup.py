"""SimHash near duplicates through a segment-popcount embedding.

A fingerprint is mapped to the numbers of set bits in segments of two bits. The Manhattan distance of two such vectors is never
above the Hamming distance of the fingerprints, so it serves as a lower bound:

* Grid: the segments are dealt to bands. If at most ``d`` bits differ, at most ``d`` bands differ, so some choice of
  ``bands - d`` bands agrees in every count. Each choice is a grid whose cell is the counts of its bands (cell width 1).
* Range join: inside a cell, members are sorted by their total count and compared while the totals are ``d`` apart at most;
  then the Manhattan distance over all segments has to be ``d`` at most.
* Exact check: the Hamming distance of the fingerprints.

A task returns the links of a spanning forest of what it compared (never all pairs), which is enough for components. Equal
fingerprints are one node, so copies cost nothing. A cell with more than ``CELL_ROWS`` members is cut into blocks and each pair
of blocks is compared on its own. Links are then closed by ``components``.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other; fewer words
than a shingle give one shingle; null ids are ignored when the smallest id of a group is taken; repeated rows share a group; an
empty table gives an empty result; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selroute.llm.common import free_name, mix, raw_texts
from selroute.llm.components import components
from selroute.llm.exact_dedup import filter_bits, slot_bitmap, with_suspicion
from selroute.session import durable

WORDS, MAX_BITS, SEED = 4, 4, 42
CELL_ROWS = 4_000
PIECE = 1 << 16


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = np.ascontiguousarray(h[i : i + (1 << 14)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return total


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, count=len(found)) + 1) - 1
    n = max(1, len(found) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    stops = ends[words - 1 :] if len(found) >= words else ends[-1:]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, PIECE):
        a, b = starts[i : i + PIECE].tolist(), stops[i : i + PIECE].tolist()
        total += bit_sums(np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, count=len(a)))
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    """64-bit fingerprint as a signed long."""

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in raw_texts(batch)], dtype=np.uint64)
            yield pa.array(values.view(np.int64), pa.int64())

    return F.arrow_udf(compute, "long")(text)


# --- comparison of the members of cells -----------------------------------------------------------------------------------


class Forest:
    """Labels of nodes that are joined link by link."""

    def __init__(self, label: np.ndarray):
        self.label = label
        self.links: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the links (a, b) joined two trees."""
        label = self.label
        taken = np.zeros(len(a), bool)
        for i in np.flatnonzero(label[a] != label[b]).tolist():
            x, y = int(a[i]), int(b[i])
            rx, ry = self._root(x), self._root(y)
            if rx != ry:
                label[max(rx, ry)] = min(rx, ry)
                self.links.append((x, y))
                taken[i] = True
        while taken.any():
            up = label[label]
            if (up == label).all():
                break
            self.label = label = up
        return taken

    def _root(self, x: int) -> int:
        label = self.label
        while label[x] != x:
            x = label[x]
        return x


def segment_counts(bits: np.ndarray) -> np.ndarray:
    """Set bits per two-bit segment of the rows of a 0/1 matrix."""
    return bits[:, 0::2] + bits[:, 1::2]


def _steps(cell: np.ndarray, totals: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in one cell whose totals are at most ``max_bits`` apart. Rows are sorted by cell, then total."""
    n = len(cell)
    left = np.arange(max(n - 1, 0))
    step = 1
    while len(left):
        left = left[left + step < n]
        # Once out of the cell or out of range, further steps are too.
        near = (cell[left] == cell[left + step]) & (totals[left + step] - totals[left] <= max_bits)
        left = left[near]
        yield left, left + step
        step += 1


def compare_cells(cell: np.ndarray, prints: np.ndarray, max_bits: int, embed: bool) -> Forest:
    """Spanning forest of all pairs in one cell with at most ``max_bits`` differing bits.

    Rows are sorted by cell, then total count. ``prints`` holds 64-bit lanes."""
    forest = Forest(np.arange(len(cell)))
    totals = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    for a, b in _steps(cell, totals, max_bits):
        open_ = forest.label[a] != forest.label[b]
        a, b = a[open_], b[open_]
        if len(a) and embed:
            x, y = (np.unpackbits(prints[i].view(np.uint8), axis=1, bitorder="little") for i in (a, b))
            bound = np.abs(segment_counts(x).astype(np.int16) - segment_counts(y)).sum(axis=1)
            a, b = a[bound <= max_bits], b[bound <= max_bits]
        if len(a):
            differing = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1)
            close = differing <= max_bits
            forest.join(a[close], b[close])
    return forest


def _compare(lanes: int, max_bits: int, embed: bool):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (cell, block). The last cell of a batch is kept until it is complete."""
        kept: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                kept = table if kept is None else pa.concat_tables([kept, table])
            if kept is None or not kept.num_rows:
                continue
            keys = np.stack([kept["cell"].to_numpy(), kept["block"].to_numpy()], axis=1)
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            ready = kept.num_rows if batch is None else (last[-1] + 1 if len(last) else 0)
            if not ready:
                continue
            part, kept = kept.slice(0, ready), kept.slice(ready)
            names = part["print"].combine_chunks()
            prints = np.frombuffer(b"".join(names.to_pylist()), dtype="<u8").reshape(-1, lanes)
            change = (keys[1:ready] != keys[: ready - 1]).any(axis=1)
            group = np.concatenate(([0], np.cumsum(change)))
            totals = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
            order = np.lexsort((totals, group))
            links = compare_cells(group[order], prints[order], max_bits, embed).links
            if links:
                a, b = (names.take(pa.array(order[np.array(x)])) for x in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([a, b], schema=schema)

    return run


def _link(prints: DataFrame, cells, lanes: int, max_bits: int, embed: bool) -> DataFrame:
    """Links (a, b) between distinct fingerprints (binary column ``print``); ``cells`` maps an (n, lanes) array to (n, grids)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int64()), ("print", pa.binary())])
        for batch in batches:
            names = batch.column("print")
            for i in range(0, len(names), 2048):
                part = names.slice(i, 2048)
                keys = cells(np.frombuffer(b"".join(part.to_pylist()), dtype="<u8").reshape(-1, lanes))
                rows = np.repeat(np.arange(len(part)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.take(pa.array(rows))], schema=schema)

    rows = prints.select("print").mapInArrow(emit, "cell long, print binary")
    return _cell_links(rows, _compare(lanes, max_bits, embed))


def _cell_links(rows: DataFrame, compare) -> DataFrame:
    """Links between the members of cells."""
    # Large cells are cut into blocks; a member goes to every pair of blocks that its own block is part of.
    counts = rows.groupBy("cell").agg(F.count("*").alias("members")).filter(F.col("members") > CELL_ROWS)
    counts = durable(counts.select("cell", F.ceil(F.col("members") / CELL_ROWS).cast("int").alias("cuts")))
    return (
        _dealt(rows, "cell", counts)
        .repartition("cell", "block")
        .sortWithinPartitions("cell", "block")
        .mapInArrow(compare, "a binary, b binary")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _dealt(rows: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Add ``block``: 0, or for a key that ``counts`` (key, cuts) cuts, one row for every pair of blocks the row is part of."""
    dealt = rows.join(counts, key, "left") if counts.limit(1).count() else rows.withColumn("cuts", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("print"), F.col("cuts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.least(own, j) * F.col("cuts") + F.greatest(own, j)
    )
    blocks_of = F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(pairs))
    return dealt.select(*rows.columns, blocks_of.alias("block"))


def popcount_cells(bands: int, max_bits: int):
    """Cells of the grids: counts of the two-bit segments of every choice of ``bands - max_bits`` bands."""
    deal = np.arange(32) % bands
    choices = list(itertools.combinations(range(bands), bands - max_bits))

    def cells(prints: np.ndarray) -> np.ndarray:
        counts = segment_counts(np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(len(prints), 8), axis=1, bitorder="little"))
        out = np.empty((len(prints), len(choices)), np.int64)
        powers = np.array([np.uint64(3) ** np.uint64(k) for k in range(32)], np.uint64)
        band_key = [counts[:, deal == b].astype(np.uint64) @ powers[: (deal == b).sum()] for b in range(bands)]
        for c, choice in enumerate(choices):
            h = np.full(len(prints), c + 1, np.uint64)
            for b in choice:
                h = mix(h + band_key[b] * np.uint64(0x9E3779B97F4A7C15))
            out[:, c] = h.view(np.int64)
        return out

    return cells


def bands_for(rows: int, max_bits: int) -> int:
    """More bands as the table grows, so that a cell keeps few members by chance."""
    return max_bits + (2 if rows < 20_000_000 else 3 if rows < 2_000_000_000 else 4)


# --- operators ------------------------------------------------------------------------------------------------------------


def _classes(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(print, component_id): the smallest id over all rows whose fingerprints are connected."""
    nodes = durable(rows.groupBy("print").agg(F.min("id").alias("least")))
    roots = components(links)
    linked = nodes.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    linked = durable(linked)
    least = durable(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    return durable(linked.join(least, "root").select("print", "component_id"))


def hamming_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per input row: id, fingerprint (signed long) and component_id."""
    rows = durable(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), words).alias("fingerprint")))
    rows = rows.withColumn("print", _little_endian(F.col("fingerprint")))
    prints = durable(rows.select("print").distinct())
    n = prints.count()
    links = durable(_link(prints, popcount_cells(bands_for(n, max_bits), max_bits), 1, max_bits, True))
    return rows.join(_classes(rows, links), "print").select("id", "fingerprint", "component_id")


def _little_endian(value: Column) -> Column:
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows that stay, with all their columns: of every group of ``hamming_groups`` the document with the smallest id.

    A document is an id with its text: an id that occurs with two texts is two documents, of which one may go, and rows that
    repeat both stay or go together. Rows without an id stay. Only rows that a Bloom filter cannot tell from the documents that
    go are shuffled with their texts."""
    key, suspect = free_name("key", docs.columns), free_name("suspect", docs.columns)
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    document = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), digest.alias("digest")))
    groups = hamming_groups(docs.select(document.alias("document"), F.col(text_col).alias("text")), "document", "text", words, max_bits)
    gone = groups.filter("id <> component_id").select(_document_key(F.col("id.id"), F.col("id.digest")).alias("digest"))
    gone = durable(gone.distinct())
    bits = filter_bits(gone.count())
    rows = docs.withColumn(key, _document_key(F.col(id_col), digest))
    rows = with_suspicion(rows, key, slot_bitmap(gone, bits, 1), bits, suspect)
    names = [F.col(f"`{c}`") for c in docs.columns]
    passed = rows.filter(~F.col(suspect)).select(*names)
    met = rows.filter(F.col(suspect)).join(gone.select(F.col("digest").alias(key)), key, "left_anti")
    return passed.unionByName(met.select(*names))


def _document_key(id_: Column, digest: Column) -> Column:
    """The id with its text's digest, in 16 bytes. A row without an id has a key that no document which goes has."""
    return F.unhex(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("none")), F.lit(":"), digest)))
