"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a hash of the eight bytes before a word boundary meets a mask, so equal passages give equal chunks wherever
they stand. A chunk is encoded once and its ids are reused for every later document of the task that has it (a least-recently-used store
of ``STORE_BYTES``). At each join the last word before and the first word after it are encoded together and apart (both whole chunks,
where a side has no whole word by the join); where that differs, the two chunks are encoded as one, and so on until all joins agree.

Reuse is per task on purpose: a store of all chunks would send texts and ids through shuffles (several times the input), while
encoding a chunk again costs less than moving it. Copies in other tasks are encoded once there.

Defined cases: a null text counts as empty; an empty text has no ids; special strings inside texts become their special id, as
the library's default has it; repeated rows are encoded like any others; an empty table gives an empty result; columns that are
added take the place of columns of the same name, all others are passed on.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selroute.llm.common import mix, slices
from selroute.llm.tokenizing import BYTE_BPE, ByteBpe, safe_cuts, tokenizer

MEAN_CUTS = 128  # one of so many word boundaries is a chunk's end: about 800 bytes
STORE_BYTES = 24 << 20
_LAST_WORD = re.compile(r"(?<=[!-~])\s+\S+$")
_FIRST_WORD = re.compile(r"\s+\S+")


def cut_points(data: bytes, mean_cuts: int = MEAN_CUTS) -> list[int]:
    """Content-defined chunk ends (byte positions): safe cuts whose preceding eight bytes hash to a multiple of ``mean_cuts``."""
    cuts = safe_cuts(data)
    padded = bytes(8) + data
    wide = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    return cuts[mix(wide[cuts]) % np.uint64(mean_cuts) == 0].tolist()


class ChunkEncoder:
    """Encodes texts chunk by chunk with a bounded store."""

    def __init__(self, name: str, mean_cuts: int = MEAN_CUTS, store_bytes: int = STORE_BYTES):
        self.tokenizer = tokenizer(name)
        self.splits = isinstance(self.tokenizer, ByteBpe)
        self.mean_cuts, self.store_bytes = mean_cuts, store_bytes
        self.store: OrderedDict[str, np.ndarray] = OrderedDict()
        self.held = self.encoded = self.reused = self.repaired = 0

    def chunk(self, text: str) -> np.ndarray:
        ids = self.store.get(text)
        if ids is not None:
            self.store.move_to_end(text)
            self.reused += 1
            return ids
        ids = np.array(self.tokenizer.encode(text), dtype="<u4")
        self.encoded += 1
        self.store[text] = ids
        self.held += len(text) + ids.nbytes
        while self.held > self.store_bytes:
            old, gone = self.store.popitem(last=False)
            self.held -= len(old) + gone.nbytes
        return ids

    def agrees(self, left: str, right: str) -> bool:
        """The words around a join give the same ids together as apart."""
        a, b = _LAST_WORD.search(left[-64:]), _FIRST_WORD.match(right)
        if a is None or b is None:
            a_text, b_text = left, right
        else:
            a_text, b_text = a.group(), b.group()
        apart = [*self.tokenizer.encode(a_text), *self.tokenizer.encode(b_text)]
        return self.tokenizer.encode(a_text + b_text) == apart

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        data = text.encode()
        ends = [*(cut_points(data, self.mean_cuts) if self.splits else []), len(data)]
        chunks, start = [], 0
        for end in ends:
            piece = data[start:end].decode()
            if chunks and not self.agrees(chunks[-1], piece):
                chunks[-1] += piece  # encoded as one, the join is gone
                self.repaired += 1
            else:
                chunks.append(piece)
            start = end
        parts = [self.chunk(c) for c in chunks]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist()).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", name: str = BYTE_BPE) -> DataFrame:
    """Add the column ``ids`` (array of int) to ``docs``."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = ChunkEncoder(name)
        for batch in batches:
            yield pa.array([encoder.encode(x or "").astype(np.int32) for x in batch.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(ids_col, encode(F.col(text_col)))


def decode_ids(tokens: DataFrame, ids_col: str = "ids", text_col: str = "text", name: str = BYTE_BPE) -> DataFrame:
    """Add the decoded text of an id column."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = ChunkEncoder(name)
        for batch in batches:
            yield pa.array([encoder.decode(np.array(x or [], dtype=np.uint32)) for x in batch.to_pylist()], pa.string())

    return tokens.withColumn(text_col, decode(F.col(ids_col)))


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = BYTE_BPE) -> DataFrame:
    """Encode and decode every text; return id, n_tokens, ids_sha256 and decoded_sha256. Ids stay inside the task."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = ChunkEncoder(name)
        for part in (part for batch in batches for part in slices(batch)):
            counts, ids_sha, text_sha = [], [], []
            for text in part:
                ids = encoder.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("d")).select("id", "d.*")


def encode_checked(docs: DataFrame, text_col: str = "text", name: str = BYTE_BPE) -> DataFrame:
    """Add n_tokens, ids (array of int) and round_trip (decoding gives the text) to the columns of ``docs`` in one pass."""

    @F.arrow_udf("struct<n_tokens:bigint,ids:array<int>,round_trip:boolean>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = ChunkEncoder(name)
        for part in (part for batch in batches for part in slices(batch)):
            texts = [x or "" for x in part.to_pylist()]
            ids = [encoder.encode(x) for x in texts]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
            values = pa.array(np.concatenate(ids).view(np.int32) if ids else [], pa.int32())
            same = [encoder.decode(x) == t for x, t in zip(ids, texts, strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(same, pa.bool_())],
                ["n_tokens", "ids", "round_trip"],
            )

    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "ids", "round_trip")]
    return docs.select(*names, encode(F.col(text_col)).alias("__encoded")).select(*names, "__encoded.*")
