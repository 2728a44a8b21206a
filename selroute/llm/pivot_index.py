"""Near-duplicate vectors through a pivot-permutation index.

Reference points (pivots) are vectors of the table itself. A vector is described by its nearest pivots in order (twelve, or
three times as many as it has lists) and entered into the inverted lists of the first few of them. Two vectors of one list are candidates if their descriptions share
``SHARED`` pivots, and candidates are links if their cosine in double precision reaches the threshold.

* Pivots: of the distinct vectors with the smallest hashes (``OVERSAMPLE`` times as many as are needed, a bounded sample) those
  that are not within ``threshold - SEPARATION`` of an earlier one. So a dense group of near copies holds one pivot, and its
  members meet in that pivot's list instead of being dealt to many by chance. Their number grows with the square root of the
  table, so a list grows with the square root as well; the number of lists per vector grows with its logarithm, which keeps the
  recall (README has it by size).
* Every row is indexed. Equal vectors are one node: a task sends one row for all copies it meets in a batch, and the task of a
  list adds up what comes from several.
* A list with more than ``LIST_ROWS`` members is cut into blocks, and every pair of blocks is compared on its own. A linked pair
  that meets in several lists counts in the one with the smallest number that both share.
* A task returns partner counts per node and a spanning forest of the links, never the pairs. ``components`` closes the forest.

The lists carry the vectors, so a table is shuffled about as many times as a vector has lists (3 to 6). The result misses links
whose ends share no list or too few pivots; it never holds a link below the threshold.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
length never link; copies link with each other, also those of one id; null ids are ignored when the smallest id of a component is
taken; an empty table gives an empty result; only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selroute.llm.components import components
from selroute.llm.simhash_dedup import Forest
from selroute.session import durable

THRESHOLD = 0.9
LEAST_DESCRIBED, SHARED = 12, 4
OVERSAMPLE, SEPARATION = 4, 0.1
LEAST_PIVOTS = 64
LIST_ROWS = 4_000
_CELLS, _PAIRS = 1 << 20, 1 << 15

_ENTRIES = "list int, block int, vector binary, pivots binary, copies long"
_FOUND = "a binary, b binary, partners long"


def pivots_for(rows: int) -> int:
    """The power of two next to twice the square root of the number of rows."""
    return max(LEAST_PIVOTS, 1 << round(math.log2(2 * math.sqrt(max(rows, 1)))))


def lists_for(pivots: int) -> int:
    """In how many lists a vector is entered."""
    return max(3, (max(pivots, 2).bit_length() - 1) // 2)


# --- vectors --------------------------------------------------------------------------------------------------------------


def unit_rows(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one in double precision, and which rows can be: finite and not zero."""
    rows = raw.astype(np.float64)
    largest = np.abs(rows).max(axis=1, initial=0)
    good = np.isfinite(rows).all(axis=1) & (largest > 0)
    rows = rows[good] / largest[good, None]  # so that no square is too large or too small
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None], good


def by_length(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)  # a null component comes as NaN
    first = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, values[first[at][:, None] + np.arange(d)]


def _kind(vectors: DataFrame, vector_col: str) -> str:
    return "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"


def choose_pivots(vectors: DataFrame, id_col: str, vector_col: str, threshold: float) -> np.ndarray:
    """Unit vectors of the pivots, chosen by hash; the same for the same distinct vectors."""
    hashed = vectors.filter(F.col(vector_col).isNotNull()).select(F.xxhash64(vector_col).alias("h"), F.col(vector_col).alias("v"))
    wanted = pivots_for(vectors.count())
    cut = hashed.groupBy("h").agg(F.count("*").alias("n")).select("h").orderBy("h").limit(OVERSAMPLE * wanted).agg(F.max("h")).first()[0]
    if cut is None:
        return np.zeros((0, 0))
    sample = hashed.filter(F.col("h") <= cut).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").toArrow()["v"].combine_chunks()
    groups = [unit_rows(rows) for _, rows in by_length(sample, "<f8")]
    units = max((u for u, _ in groups), key=len, default=np.zeros((0, 0)))  # of the commonest length
    chosen = np.zeros((min(wanted, len(units)), units.shape[1]))
    n = 0
    for u in units:
        if n < len(chosen) and (chosen[:n] @ u < threshold - SEPARATION).all():
            chosen[n] = u
            n += 1
    return chosen[:n]


def nearest_pivots(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first. Pivots are cut or filled up with zeros to the rows' length."""
    d = units.shape[1]
    fitted = np.pad(pivots[:, :d], ((0, 0), (0, max(0, d - pivots.shape[1]))))
    k = min(max(LEAST_DESCRIBED, 3 * lists_for(len(pivots))), len(pivots))
    out = np.empty((len(units), k), "<i4")
    for i in range(0, len(units), 4096):
        s = units[i : i + 4096] @ fitted.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.lexsort((top, -np.take_along_axis(s, top, axis=1)))
        out[i : i + 4096] = np.take_along_axis(top, order, axis=1)
    return out


def _distinct(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct row, and how often it occurs."""
    names = np.ascontiguousarray(raw).view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel()
    _, first, copies = np.unique(names, return_index=True, return_counts=True)
    return first, copies


def _own_block(vector: bytes, cuts: int) -> int:
    return xxhash.xxh64_intdigest(vector) % cuts


# --- inverted lists -------------------------------------------------------------------------------------------------------


def _described(batch: pa.RecordBatch, pivots: np.ndarray, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct vectors of a batch as raw rows, copies and nearest pivots."""
    for _, raw in by_length(batch.column(0), kind):
        units, good = unit_rows(raw)
        if len(units):
            raw = raw[good]
            first, copies = _distinct(raw)
            yield raw[first], copies, nearest_pivots(units[first], pivots)


def _list_sizes(pivots: np.ndarray, lists: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(len(pivots), np.int64)
        for batch in batches:
            for _, _, near in _described(batch, pivots, kind):
                sizes += np.bincount(near[:, :lists].ravel(), minlength=len(sizes))
        at = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sizes[at])], ["list", "members"])

    return run


def _enter(pivots: np.ndarray, lists: int, kind: str, cuts: np.ndarray):
    names = ["list", "block", "vector", "pivots", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, copies, near in _described(batch, pivots, kind):
                for i in range(0, len(raw), 1024):
                    part = slice(i, i + 1024)
                    vector = [row.tobytes() for row in raw[part]]
                    described = [row.tobytes() for row in near[part]]
                    row = np.repeat(np.arange(len(vector)), min(lists, near.shape[1]))
                    entry = near[part, :lists].ravel()
                    block = np.zeros(len(entry), np.int32)
                    cut = cuts[entry] > 1
                    if cut.any():  # a member of a large list goes to every pair of blocks that its own block is part of
                        more = []
                        for r, e in zip(row[cut].tolist(), entry[cut].tolist(), strict=True):
                            own, c = _own_block(vector[r], int(cuts[e])), int(cuts[e])
                            more += [(r, e, min(own, j) * c + max(own, j)) for j in range(c)]
                        extra = np.array(more)
                        row, entry, block = (
                            np.concatenate([x[~cut], extra[:, k]]) for k, x in enumerate((row, entry, block))
                        )
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(entry.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(vector, pa.binary()).take(at),
                            pa.array(described, pa.binary()).take(at), pa.array(copies[part].astype(np.int64)).take(at),
                        ],
                        names,
                    )

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (list, block), one table for each."""
    kept: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(starts, starts[1:], strict=False):
            if a == b:
                continue
            if kept and tuple(keys[a]) != key:
                yield pa.Table.from_batches(kept)
                kept = []
            key = tuple(keys[a])
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)


def shared_counts(bits: np.ndarray, rows: slice) -> np.ndarray:
    """How many pivots each of the rows shares with every row."""
    out = np.zeros((len(bits[rows]), len(bits)), np.uint16)
    for word in bits.T:
        out += np.bitwise_count(word[rows, None] & word[None, :])
    return out


def linked_pairs(units: np.ndarray, near: np.ndarray, pivots: int, own: np.ndarray | None, threshold: float):
    """Pairs (i, j), i below j, that share enough pivots and have a cosine of at least the threshold, in pieces. With ``own``, only
    pairs of different blocks."""
    n = len(units)
    bits = np.zeros((n, (pivots + 63) // 64), np.uint64)
    for k in range(near.shape[1]):
        bits[np.arange(n), near[:, k] >> 6] |= np.uint64(1) << (near[:, k] & 63).astype(np.uint64)
    used = bits.any(axis=0)
    bits, enough = bits[:, used], min(SHARED, near.shape[1])
    step = max(1, _CELLS // n)
    for a in range(0, n, step):
        left, right = np.nonzero(shared_counts(bits, slice(a, a + step)) >= enough)
        left += a
        ahead = left < right
        if own is not None:
            ahead &= own[left] != own[right]
        left, right = left[ahead], right[ahead]
        for b in range(0, len(left), _PAIRS):
            i, j = left[b : b + _PAIRS], right[b : b + _PAIRS]
            close = np.einsum("ij,ij->i", units[i], units[j]) >= threshold
            if close.any():
                yield i[close], j[close]


def _compare(pivots: int, lists: int, kind: str, cuts: np.ndarray, threshold: float):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("partners", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            here, block = table["list"][0].as_py(), table["block"][0].as_py()
            place: dict[bytes, int] = {}
            at = np.array([place.setdefault(v, len(place)) for v in table["vector"].to_pylist()])
            copies = np.bincount(at, weights=table["copies"].to_numpy()).astype(np.int64)
            first = np.unique(at, return_index=True)[1]
            described = table["pivots"].combine_chunks().take(pa.array(first)).to_pylist()
            near = np.frombuffer(b"".join(described), "<i4").reshape(len(first), -1)
            names = list(place)
            crossed = cuts[here] > 1 and block // cuts[here] != block % cuts[here]
            lengths = np.fromiter(map(len, names), np.int64, count=len(names))
            for size in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == size)
                units, _ = unit_rows(np.frombuffer(b"".join(names[i] for i in mine), kind).reshape(len(mine), -1))
                own = np.array([_own_block(names[i], int(cuts[here])) for i in mine]) if crossed else None
                forest, partners = Forest(np.arange(len(mine))), np.zeros(len(mine), np.int64)
                entered = near[mine, :lists]
                for i, j in linked_pairs(units, near[mine], pivots, own, threshold):
                    # A pair counts in the first of the lists that both ends are in.
                    both = (entered[i][:, :, None] == entered[j][:, None, :]).any(axis=2)
                    counts = np.where(both, entered[i], pivots).min(axis=1) == here
                    i, j = i[counts], j[counts]
                    partners += np.bincount(i, copies[mine[j]], len(mine)).astype(np.int64)
                    partners += np.bincount(j, copies[mine[i]], len(mine)).astype(np.int64)
                    forest.join(i, j)
                digest = [xxhash.xxh3_128_digest(names[i]) for i in mine]
                some = np.flatnonzero(partners).tolist()
                a = [digest[i] for i, _ in forest.links] + [digest[i] for i in some]
                b = [digest[j] for _, j in forest.links] + [None] * len(some)
                n = [None] * len(forest.links) + partners[some].tolist()
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((a, b, n), schema.types, strict=True)], schema=schema)

    return run


# --- operator -------------------------------------------------------------------------------------------------------------


def _name_rows(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node: list[bytes | None] = [None] * batch.num_rows
            for at, raw in by_length(batch.column(1), kind):
                good = unit_rows(raw)[1]
                for i, row in zip(at[good].tolist(), raw[good], strict=True):
                    node[i] = xxhash.xxh3_128_digest(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary())], ["id", "node"])

    return run


def index_links(vectors: DataFrame, id_col: str, vector_col: str, threshold: float) -> DataFrame:
    """(a, b, partners): links of spanning forests as (a, b), and partner counts of node ``a``, to be added up, with null ``b``."""
    kind = _kind(vectors, vector_col)
    pivots = choose_pivots(vectors, id_col, vector_col, threshold)
    column = vectors.select(F.col(vector_col).alias("vector"))
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], _FOUND)
    lists = lists_for(len(pivots))
    sizes = column.mapInArrow(_list_sizes(pivots, lists, kind), "list int, members long")
    large = sizes.groupBy("list").agg(F.sum("members").alias("members")).filter(F.col("members") > LIST_ROWS).collect()  # a row a pivot at most
    cuts = np.ones(len(pivots), np.int64)
    for r in large:
        cuts[r["list"]] = -(-r["members"] // LIST_ROWS)
    entries = column.mapInArrow(_enter(pivots, lists, kind, cuts), _ENTRIES)
    dealt = entries.repartition("list", "block").sortWithinPartitions("list", "block")
    return dealt.mapInArrow(_compare(len(pivots), lists, kind, cuts, threshold), _FOUND)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id (smallest id reachable) and kept."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    rows = durable(named.mapInArrow(_name_rows(_kind(vectors, vector_col)), f"id {id_type}, node binary"))
    found = durable(index_links(vectors, id_col, vector_col, threshold))
    partners = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("partners").alias("partners"))
    roots = durable(components(found.filter("b is not null").select("a", "b")))
    nodes = durable(rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least")))
    linked = durable(nodes.join(roots, "node"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").join(partners, "node").select("node", "partners", "component_id")
    judged = durable(nodes.join(linked, "node", "left").filter("copies > 1 or partners is not null"))
    out = rows.join(judged.withColumnRenamed("component_id", "reached"), "node", "left")
    component = F.coalesce("reached", "least", "id")
    links = F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("partners", F.lit(0))
    return out.select("id", links.alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
