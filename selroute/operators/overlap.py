"""Corpus scoring of (prediction, reference) pairs: token-F1 and sentence BLEU-4.

A score depends on its own row only, so nothing is shuffled: tokens come from column expressions, an Arrow function counts what
both sides share, and the formulas are expressions again. The function works on columns: the tokens of a block of rows become
codes in one dictionary, longer grams are codes of (shorter gram, next token), and what a row shares is the sum of the smaller
counts of each (row, code). A repeated id is scored once per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selroute.functions.text import answer_line, mteval_line

ORDERS = (1, 2, 3, 4)
BLOCK_BYTES = 4 << 20


def _slices(pred: pa.Array, ref: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of rows of about ``BLOCK_BYTES`` of text (a longer row is a run of its own)."""
    sizes = np.add(*(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (pred, ref)))
    block = np.cumsum(sizes + 1) // BLOCK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield pred[a:b], ref[a:b]


def _coded(texts: pa.Array, other: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], int]:
    """Row and code of each token on both sides, and the number of codes. Tokens come as one text, between blanks."""
    sides = []
    for x in (texts, other):
        lists = pc.split_pattern(x.cast(pa.large_string()), " ")
        tokens = pc.list_flatten(lists)
        kept = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False)  # between two blanks
        rows = np.repeat(np.arange(len(x)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        sides.append((rows[kept], tokens.filter(pa.array(kept))))
    both = pa.concat_arrays([t for _, t in sides]).dictionary_encode()
    codes = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(sides[0][0])
    return (sides[0][0], codes[:n]), (sides[1][0], codes[n:]), len(both.dictionary)


def _shared(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], kinds: int, rows: int) -> np.ndarray:
    """Size of the multiset intersection of both sides' codes, row by row."""
    (a, n), (b, m) = (np.unique(row * kinds + code, return_counts=True) for row, code in (left, right))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return np.bincount(a[i] // max(kinds, 1), np.minimum(n[i], m[j]), rows).astype(np.int64)


def _longer(sides: list, tokens: list, order: int) -> tuple[list, int]:
    """Codes of the grams one token longer: each gram with the token behind it, where that is in the same row."""
    keys, rows = [], []
    kinds = 1 + max((int(c.max(initial=0)) for _, c in tokens))
    for (row, code), (token_row, token) in zip(sides, tokens, strict=True):
        n = max(len(token) - order + 1, 0)
        first, last = token_row[:n], token_row[order - 1 :]
        # The grams one shorter lie at the same starts, without those whose row had no room for them.
        place = np.flatnonzero(token_row[: len(token) - order + 2] == token_row[order - 2 :]) if order > 2 else np.arange(len(token))
        whole = np.flatnonzero(first == last)
        at = np.searchsorted(place, whole)
        keys.append(code[at] * kinds + token[whole + order - 1])
        rows.append(first[whole])
    distinct, coded = np.unique(np.concatenate(keys), return_inverse=True)
    return [(rows[0], coded[: len(keys[0])]), (rows[1], coded[len(keys[0]) :])], len(distinct)


def _count_overlap(orders: Sequence[int]):
    """Arrow function: for each order the shared grams, then the grams of the prediction by order, then the reference's tokens."""

    def count(pred: pa.Array, ref: pa.Array) -> pa.Array:
        columns: list[list[np.ndarray]] = [[] for _ in range(2 * len(orders) + 1)]
        for p, r in _slices(pred, ref):
            left, right, kinds = _coded(p, r)
            sides, tokens, size = [left, right], [left, right], len(p)
            for k, order in enumerate(orders):
                if order > 1:
                    sides, kinds = _longer(sides, tokens, order)
                columns[k].append(_shared(*sides, kinds, size))
                columns[len(orders) + k].append(np.bincount(sides[0][0], minlength=size))
            columns[-1].append(np.bincount(right[0], minlength=size))
        arrays = [pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()) for c in columns]
        return pa.StructArray.from_arrays(arrays, _fields(orders))

    return count


def _fields(orders: Sequence[int]) -> list[str]:
    return [*(f"same_{n}" for n in orders), *(f"total_{n}" for n in orders), "n_ref"]


def _overlap(orders: Sequence[int]):
    # Types are read off the column functions, so annotations are set for the function made here.
    count = _count_overlap(orders)
    count.__annotations__ = {"pred": pa.Array, "ref": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, "struct<" + ",".join(f"{f}:bigint" for f in _fields(orders)) + ">")


def score_token_f1(df: DataFrame, row_id: str, pred: str = "pred", ref: str = "ref", out: str = "f1_complete") -> DataFrame:
    """Token-F1 on multisets of normalised tokens. Two empty texts score 1, one empty text scores 0.

    Pairs without a prediction or reference are left out; join back on the id to keep them as NULL.
    """
    known = df.where(F.col(pred).isNotNull() & F.col(ref).isNotNull())
    counted = _overlap((1,))(answer_line(F.col(pred)), answer_line(F.col(ref)))
    totals = known.select(row_id, counted.alias("__c")).select(
        row_id, F.col("__c.same_1").alias("same"), F.col("__c.total_1").alias("n_pred"), "__c.n_ref"
    )
    precision, recall = F.col("same") / F.col("n_pred"), F.col("same") / F.col("n_ref")
    score = (
        F.when((F.col("n_pred") == 0) & (F.col("n_ref") == 0), 1.0)
        .when(F.col("same") == 0, 0.0)
        .otherwise(F.lit(2.0) * precision * recall / (precision + recall))
    )
    return totals.select(row_id, score.alias(out))


def score_bleu4(df: DataFrame, row_id: str, pred: str = "pred", ref: str = "ref", out: str = "bleu_complete") -> DataFrame:
    """Sentence BLEU up to 4-grams in 0..1: mteval-13a tokens, exponential smoothing, effective order.

    An order without any match counts as 1 / (2^k * total) for the k-th such order, orders longer than the
    prediction are left out of the mean, and a pair with no match at all scores 0.
    """
    known = df.where(F.col(pred).isNotNull() & F.col(ref).isNotNull())
    counted = _overlap(ORDERS)(mteval_line(F.col(pred)), mteval_line(F.col(ref)))
    totals = known.select(row_id, counted.alias("__c")).select(row_id, "__c.*")

    log_sum, orders, misses = F.lit(0.0), F.lit(0), F.lit(0)
    for n in ORDERS:
        same, total = F.col(f"same_{n}").cast("double"), F.col(f"total_{n}").cast("double")
        misses = misses + F.when((total > 0) & (same == 0), 1).otherwise(0)
        share = F.when(same > 0, same / F.nullif(total, F.lit(0.0))).otherwise(
            F.lit(1.0) / (F.pow(F.lit(2.0), misses) * F.nullif(total, F.lit(0.0)))
        )
        log_sum = log_sum + F.when(total > 0, F.log(share)).otherwise(0.0)
        orders = orders + F.when(total > 0, 1).otherwise(0)
    n_pred, n_ref = F.col("total_1"), F.col("n_ref")
    brevity = F.when(n_pred >= n_ref, 1.0).otherwise(F.exp(F.lit(1.0) - n_ref / F.nullif(n_pred, F.lit(0))))
    any_match = sum((F.col(f"same_{n}") for n in (2, 3, 4)), F.col("same_1")) > 0
    score = F.when(any_match, brevity * F.exp(log_sum / F.nullif(orders, F.lit(0)))).otherwise(0.0)
    return totals.select(row_id, score.alias(out))
