"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are split at positions no token reaches over, the pieces of a batch are grouped to runs of about equal UTF-8 bytes, each
run is one batch call of the library, and the lengths of pieces are added up per text. Nothing is shuffled and no ids leave the
Python worker. A text without any safe position (one endless word) stays in one piece; so do all texts of models whose
normaliser needs them whole.

Defined cases: a null text counts as empty and has no bytes and no tokens; rows that repeat are counted like any others; an empty
table gives an empty result; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selroute.llm.tokenizing import BYTE_BPE, ByteBpe, tokenizer, split_safely

PIECE_CHARS = 1 << 16
BATCH_BYTES = 1 << 20


def utf8_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def balanced(pieces: Iterable[tuple[int, str]], limit: int) -> Iterator[list[tuple[int, str]]]:
    """Runs of pieces of about ``limit`` bytes each."""
    held, run = 0, []
    for piece in pieces:
        run.append(piece)
        held += utf8_length(piece[1]) + 1
        if held >= limit:
            yield run
            held, run = 0, []
    if run:
        yield run


def token_lengths(text: Column, name: str = BYTE_BPE, batch_bytes: int = BATCH_BYTES) -> Column:
    """Number of tokens of a text column, without added special tokens."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = tokenizer(name)
        split = isinstance(t, ByteBpe)
        for batch in batches:
            totals = np.zeros(len(batch), np.int64)
            pieces = (
                (i, p) for i, x in enumerate(batch) for p in (split_safely(x.as_py() or "", PIECE_CHARS) if split else [x.as_py() or ""])
            )
            for run in balanced(pieces, batch_bytes):
                np.add.at(totals, [i for i, _ in run], t.lengths([p for _, p in run]))
            yield pa.array(totals, pa.int64())

    return count(text)


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = BYTE_BPE, limit: int = 1024
) -> DataFrame:
    """Return id, n_bytes (UTF-8), n_tokens and over_limit for every row."""
    counted = docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        token_lengths(F.col(text_col), name).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
