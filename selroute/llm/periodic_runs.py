"""Periodic runs of words, found through multi-scale minimizers.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical), of length at least
``max(6, 4 * q)``, that no neighbouring word extends keeping the period. Each document is searched inside its row:

* Periods below ``LAGS`` are too short for minimizers: every such lag is scanned directly.
* Scale ``P`` (powers of two from ``LAGS`` on) finds the periods from ``P`` to ``2 P - 1``. The text is read as overlapping grams of
  ``P`` words, and the least gram of every window of ``2 P`` grams is a minimizer. Inside a run, windows one period apart hold the
  same words, so their minima lie one period apart; the whole of both windows fits into four periods. Pairs of equal minimizers
  from ``P`` to ``2 P - 1`` apart are the seeds.
* Grams inside a run of a period of ``P / 4`` at most (all known from smaller scales) are never minimizers. Every period of a
  longer run holds a gram that is not of this kind, so no run is lost; and equal grams are more than ``P / 4`` words apart, so a
  gram has seven partners at most and seeds stay in proportion to the text.
* A seed is extended to both sides by binary search over prefix hashes, and what comes out is compared word by word. Should a
  hash have lied, the seed is extended again over the words themselves.

Scales stop at a quarter of a text's length; texts of a block are ordered by length, so a scale reads only texts that can hold
its periods. Work is about the text's length times the logarithm of its length, without a shuffle.

Defined cases: a null text counts as empty and has no run; words are case-sensitive and split at ASCII white space; repeated rows
and null ids are judged row by row; an empty table gives an empty result; only the text is read, so other columns may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selroute.llm.common import blocks, mix, raw_texts

LAGS = 8  # a power of two: the first scale
REPEATS, LEAST = 4, 6  # a run holds four periods and six words
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
_NONE = np.uint64((1 << 64) - 1)

RESULT = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Prefix:
    """Hashes of any stretch of an array of word numbers, by prefix sums."""

    def __init__(self, ids: np.ndarray):
        value = mix(ids.astype(np.uint64) + np.uint64(1))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * _powers(_BASE, len(ids)), dtype=np.uint64)))
        self.back = _powers(pow(_BASE, -1, 1 << 64), len(ids) + 1)

    def grams(self, size: int, n: int) -> np.ndarray:
        """Hashes of all grams of ``size`` words within the first ``n`` words."""
        return (self.sums[size : n + 1] - self.sums[: n + 1 - size]) * self.back[: n + 1 - size]

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        x = (self.sums[a + size] - self.sums[a]) * self.back[a]
        return x == (self.sums[b + size] - self.sums[b]) * self.back[b]

    def reach(self, a: np.ndarray, lag: np.ndarray, room: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from (or before) ``a`` on equal those ``lag`` later, at most ``room``."""
        low, high = np.zeros(len(a), np.int64), room.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            start = a if forward else a - half
            fits = self.same(start, start + lag, half)
            low, high = np.where(fits, half, low), np.where(fits, high, half - 1)
        return low


def _long_enough(length, period):
    return length >= np.maximum(LEAST, REPEATS * period)


def _scan_lag(ids: np.ndarray, q: int) -> np.ndarray:
    """(start, end, period) of all stretches of period ``q`` that are long enough."""
    equal = np.zeros(max(len(ids) - q, 0) + 2, np.int8)
    equal[1:-1] = ids[q:] == ids[:-q] if len(ids) > q else 0
    step = np.diff(equal)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + q
    good = _long_enough(end - start, q)
    return np.stack([start[good], end[good], np.full(good.sum(), q)], axis=1)


def _exact(ids: np.ndarray, at: int, q: int, first: int, last: int) -> tuple[int, int]:
    """Extent of period ``q`` around the pair (at, at + q) of one text, word by word."""
    start, end = at, at + q
    while start > first and ids[start - 1] == ids[start - 1 + q]:
        start -= 1
    while end < last and ids[end] == ids[end - q]:
        end += 1
    return start, end


def _periodic_starts(found: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which grams of ``size`` words lie in a found run with a period of a quarter of the gram at most."""
    inside = found[found[:, 2] * REPEATS <= size]
    inside = inside[(inside[:, 1] - inside[:, 0] >= size) & (inside[:, 0] < n)]
    edges = np.zeros(n + 2, np.int64)
    np.add.at(edges, inside[:, 0], 1)
    np.add.at(edges, np.minimum(inside[:, 1] - size + 1, n + 1), -1)
    return np.cumsum(edges)[:n] > 0


def _seeds(hashes: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of equal minimizers from ``scale`` to ``2 * scale - 1`` apart. ``hashes`` holds a hash per gram, _NONE for
    grams that take no part."""
    width = np.uint64(max(1, len(hashes).bit_length()))
    order = np.where(hashes == _NONE, _NONE, (hashes >> width << width) | np.arange(len(hashes), dtype=np.uint64))
    least, reach = order, 1
    while reach < 2 * scale and len(least) > reach:  # the window's size is a power of two
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    chosen = np.unique(least[np.concatenate(([True], least[1:] != least[:-1]))]) if len(least) else least
    chosen = chosen[chosen != _NONE]  # by gram, then position
    gram, position = chosen >> width, (chosen & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    at, lags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = np.arange(len(chosen))
    step = 1
    while len(left):
        left = left[left + step < len(chosen)]
        apart = position[left + step] - position[left]
        near = (gram[left + step] == gram[left]) & (apart < 2 * scale)
        left, apart = left[near], apart[near]
        wide = apart >= scale
        at.append(position[left[wide]])
        lags.append(apart[wide])
        step += 1
    return np.concatenate(at), np.concatenate(lags)


def _runs_of_block(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs. ``ids`` holds the words of texts by falling size, each text followed by a number that
    occurs nowhere else; ``first`` and ``sizes`` say where the texts are."""
    found = [_scan_lag(ids, q) for q in range(1, LAGS)]
    known = np.concatenate(found)
    prefix, scale = None, LAGS
    while len(sizes) and scale * REPEATS <= sizes[0]:
        texts = int(np.searchsorted(-sizes, -scale * REPEATS, side="right"))
        n = int(first[texts - 1] + sizes[texts - 1] + 1)
        prefix = prefix or _Prefix(ids)
        hashes = mix(prefix.grams(scale, n))
        hashes[hashes == _NONE] -= np.uint64(1)
        hashes[_periodic_starts(known, scale, len(hashes))] = _NONE
        at, lag = _seeds(hashes, scale)
        if len(at):
            known = np.concatenate([known, _extend(ids, prefix, at, lag, first, sizes)])
        scale *= 2
    if not len(known):
        return known
    # Of equal stretches the smallest period counts: the others are its multiples.
    known = known[np.lexsort((known[:, 2], known[:, 1], known[:, 0]))]
    keep = np.concatenate(([True], (known[1:, :2] != known[:-1, :2]).any(axis=1)))
    return known[keep]


def _extend(ids: np.ndarray, prefix: _Prefix, at: np.ndarray, lag: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    text = np.searchsorted(first, at, side="right") - 1
    begin, stop = first[text], first[text] + sizes[text]
    inside = at + lag < stop
    at, lag, begin, stop = at[inside], lag[inside], begin[inside], stop[inside]
    start = at - prefix.reach(at, lag, at - begin, False)
    end = at + lag + prefix.reach(at, lag, stop - at - lag, True)
    rows = np.stack([start, end, lag, at, begin, stop], axis=1)[_long_enough(end - start, lag)]
    if not len(rows):
        return np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # Seeds of one run agree in extent and lag; one of them stands for all, if the words say the same as the hashes.
    bounds = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1), [True])))
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        s, e, q, _, low, high = rows[i].tolist()
        whole = np.array_equal(ids[s : e - q], ids[s + q : e])
        if whole and (s == low or ids[s - 1] != ids[s - 1 + q]) and (e == high or ids[e] != ids[e - q]):
            out.append((s, e, q))
            continue
        done = -1
        for a in rows[i:j, 3].tolist():
            if a >= done and ids[a] == ids[a + q]:
                s, done = _exact(ids, a, q, low, high)
                if done - s >= max(LEAST, REPEATS * q):
                    out.append((s, done, q))
    return np.array(out, np.int64).reshape(-1, 3)


def find_in_texts(texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs (start, length, period) by start, then period, and the collapsed text, of every text: words that some run holds after
    its first period are left out, the others joined by one space."""
    words = [t.split() for t in texts]
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    sizes = np.array([len(words[i]) for i in order], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.full(int((sizes + 1).sum()), -1, np.int64)
    for i, a, n in zip(order, first.tolist(), sizes.tolist(), strict=True):
        ids[a : a + n] = np.fromiter(map(number.__getitem__, words[i]), np.int64, count=n)
    ends = first + sizes
    ids[ends] = len(number) + np.arange(len(ends))
    runs = _runs_of_block(ids, first, sizes)
    out: list = [([], b" ".join(w)) for w in words]
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1
    for k in np.unique(owner).tolist():
        mine = runs[owner == k]
        mine[:, :2] -= first[k]
        mine = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
        edges = np.zeros(int(sizes[k]) + 1, np.int64)
        np.add.at(edges, mine[:, 0] + mine[:, 2], 1)
        np.add.at(edges, mine[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()
        text = words[order[k]]
        out[order[k]] = ([(s, e - s, q) for s, e, q in mine.tolist()], b" ".join([text[i] for i in kept]))
    return out


def runs_column(text: Column) -> Column:
    """Struct of the runs of a text and the text without its repeated words."""

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for _, part in blocks(raw_texts(batch), BLOCK):
                found = find_in_texts(part)
                bounds = np.cumsum([0, *[len(r) for r, _ in found]])
                flat = np.array([x for r, _ in found for x in r], np.int64).reshape(-1, 3)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)
                texts = pa.array([t for _, t in found], pa.binary()).cast(pa.string())
                yield pa.StructArray.from_arrays([lists, texts], ["runs", "collapsed"])

    return F.arrow_udf(compute, RESULT)(text)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, runs (array of start, length, period by start, then period) and collapsed (the text left)."""
    rows = docs.select(F.col(id_col).alias("id"), runs_column(F.col(text_col)).alias("found"))
    return rows.select("id", "found.runs", "found.collapsed")


def longest_run(runs: Column) -> Column:
    """Struct (start, length, period) of the longest run; ties go to the smallest start, then period. Null without a run."""
    key = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(key.isNotNull(), F.struct((-key["s"]).alias("start"), key["length"].alias("length"), (-key["p"]).alias("period")))


def runs_digest(runs: Column) -> Column:
    """SHA-256 of all runs as lines ``start,length,period``."""
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.sha2(F.array_join(line, ""), 256)


def plant_periods(text: Column, id_: Column) -> Column:
    """The text, or for one id in ten (by crc32 of the id) a text that turns periodic at one of its words: with
    ``g = crc32 div 10`` every word from word ``a = g % n`` on repeats the ``1 + (n - a) div (3 + g % 8)`` words there."""
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")
    # A text without a word has no place to start at; the rest of the expression is not read for it.
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(r"[^\x20\x09-\x0D]"), planted).otherwise(text)
