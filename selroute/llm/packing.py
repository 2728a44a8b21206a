"""Token-id output: documents packed into rows of fixed length by best-fit-decreasing.

Every task packs its own documents, block by block (``BLOCK_BYTES`` of text each), so nothing is shuffled and memory is bounded;
only the last rows of a block can be left partly empty. A document longer than a row is split without loss: full rows first, the
rest is packed like a short document. Pieces are placed in order of decreasing length; a segment tree over free capacities finds
the fullest row that still has room.

Each output row has the ids (little-endian, 16 bits where the vocabulary allows it), the cumulative segment lengths, positions that restart at 0
with every segment, and for each segment its document and the offset in it, from which documents can be rebuilt.

Defined cases: null and empty texts have no ids and stand in no row; repeated rows are packed like others; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selroute.llm.common import blocks, raw_texts
from selroute.llm.tokenizing import BYTE_BPE, tokenizer

ROW_TOKENS = 1024
BLOCK_BYTES = 6 << 20
PAD = 0
_PACKED = (
    "part int, block int, row int, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<bigint>, offsets array<int>"
)


class FreeRows:
    """Rows by free capacity, with a segment tree that finds the smallest sufficient capacity in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._count(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """A row with the least free capacity of at least ``size``."""
        node = size + self.leaves
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1  # up until a sibling to the right holds a row
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        free = node - self.leaves
        self._count(free, -1)
        return free, self.rows[free].pop()

    def _count(self, free: int, change: int) -> None:
        node = free + self.leaves
        while node:
            self.tree[node] += change
            node >>= 1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The row of every piece (1 to ``capacity`` long) and the number of rows."""
    rows = np.empty(len(lengths), np.int64)
    free, used = FreeRows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = free.take(size)
        left, row = found if found else (capacity, used)
        used += found is None
        rows[i] = row
        if left > size:
            free.add(left - size, row)
    return rows, used


def pack_block(ids: list[np.ndarray], doc_ids: list, capacity: int = ROW_TOKENS) -> Iterator[dict]:
    """Rows of one block of documents."""
    pieces = [(d, o, min(capacity, len(x) - o)) for d, x in enumerate(ids) for o in range(0, len(x), capacity)]
    if not pieces:
        return
    rows, _ = best_fit_decreasing(np.array([n for *_, n in pieces]), capacity)
    by_row: dict[int, list[int]] = {}
    for i, row in enumerate(rows.tolist()):
        by_row.setdefault(row, []).append(i)
    kind = ids[0].dtype
    for row in sorted(by_row):
        segments = [pieces[i] for i in by_row[row]]
        matrix = np.full(capacity, PAD, kind)
        positions = np.zeros(capacity, "<u2" if capacity <= 65536 else "<u4")
        ends = np.cumsum([0, *(n for *_, n in segments)])
        for (d, o, n), at in zip(segments, ends.tolist(), strict=False):
            matrix[at : at + n] = ids[d][o : o + n]
            positions[at : at + n] = np.arange(n)
        yield {
            "row": row, "n_tokens": int(ends[-1]), "ids": matrix.tobytes(), "cu_seqlens": ends.tolist(), "positions": positions.tobytes(),
            "doc_ids": [doc_ids[d] for d, *_ in segments], "offsets": [o for _, o, _ in segments],
        }


_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
     ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32()))]
)


def pack_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = BYTE_BPE, capacity: int = ROW_TOKENS
) -> DataFrame:
    """Packed rows of all texts; (part, block, row) names a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, block = tokenizer(name), TaskContext.get().partitionId(), 0
        kind = "<u2" if len(getattr(t, "pieces", ())) - 1 in range(65536) else "<u4"
        for batch in batches:
            names = batch.column("id").to_pylist()
            for first, run in blocks(raw_texts(batch.column("text")), BLOCK_BYTES):
                ids = [np.array(t.encode(x.decode()), dtype=kind) for x in run]
                rows = [{"part": part, "block": block, **r} for r in pack_block(ids, names[first : first + len(run)], capacity)]
                block += 1
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(pack, _PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet files of binary matrices rows, with their cumulative lengths and positions."""
    packed.write.mode("errorifexists").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """Packed rows with SHA-256 in place of the binaries."""
    return packed.withColumns({"ids_sha256": F.sha2("ids", 256), "positions_sha256": F.sha2("positions", 256)}).drop("ids", "positions")


def unpack(packed_rows: list[dict], kind: str = "<u2") -> dict[int, np.ndarray]:
    """Documents rebuilt from their packed rows (for checks on collected samples)."""
    parts: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in packed_rows:
        ids, ends = np.frombuffer(r["ids"], kind), r["cu_seqlens"]
        for doc, offset, a, b in zip(r["doc_ids"], r["offsets"], ends, ends[1:], strict=False):
            parts.setdefault(doc, []).append((offset, ids[a:b]))
    return {d: np.concatenate([x for _, x in sorted(p, key=lambda y: y[0])]) for d, p in parts.items()}
