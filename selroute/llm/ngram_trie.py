"""Bigram language model in an Elias-Fano trie, built and queried in shards.

A word's node holds the contexts it was seen in, as in tries that read an n-gram from its last word backwards. Level one is the
sorted list of word hashes with quantised unigram probabilities; monotone pointers lead to level two, the context hashes of each
word, relative to the word's rank, with quantised smoothed probabilities. Both pointer list and level two are Elias-Fano coded;
the levels are files that a task maps into memory and removes when its shard is done.

Smoothing (Dirichlet prior): ``p(w|v) = (c(v,w) + MU * p1(w)) / (c(v) + MU)`` with ``p1(w) = (c(w) + 1) / (N + V + 1)``. The
numerator needs only what is stored under w and the denominator only the count of v, so each token is scored by parts in the shards
of its own word and one shuffle carries counts and questions alike:

1. Blocks of documents send their distinct training words with counts to shards by word; these give N, V and the words with more
   than a quarter of a shard's share (at most four per shard), the only thing that reaches the driver.
2. Blocks send their distinct (word, context) pairs with references to their documents. The shard of a pair is a hash of the word,
   for the frequent words of step 1 a hash of the pair, so no word fills a task. A shard counts what comes from training documents,
   builds its trie, asks it for every pair and adds up per document it was asked about.
3. A shard answers a block with the sums of the documents it met there, and with nothing for the others. So all answers to a
   block hold no more entries than the block has tokens, whatever the number of shards is; they are added up by block.

The number of shards follows the corpus (``SHARD_TOKENS`` tokens each) without a limit. Nothing is pruned or sampled. Pairs are told
apart by 64 bits of the word and ``CONTEXT_BITS`` bits of the context: of a word with c different contexts about c / 2 ** 32 share
their count with another one; word counts rest on all 64 bits.

Defined cases: null and empty texts are a single end token; a row without an id is held out; repeated rows count each time; with
no training text every count is zero.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selroute.llm.common import blocks, find_words, hash_words, mix, raw_texts
from selroute.session import durable

BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 60_000
SHARD_TOKENS = 2_000_000
MU = 100.0
CONTEXT_BITS = 32
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_Q_LOW, _Q_STEP = -20.0, 1 / 2000  # log10 values from -20 up in 16 bits


# --- Elias-Fano -----------------------------------------------------------------------------------------------------------


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each 64-bit word, by halving."""
    at = np.zeros(len(word), np.uint64)
    k = k.astype(np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        low = (word >> at) & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.uint64)
        over = k >= ones
        k = np.where(over, k - ones, k)
        at = np.where(over, at + np.uint64(width), at)
    return at.astype(np.int64)


class EliasFano:
    """A monotone list of integers below ``universe``: low bits packed, high bits in unary with a rank directory."""

    def __init__(self, low: np.ndarray, high: np.ndarray, low_bits: int, n: int):
        self.low, self.high, self.low_bits, self.n = low, high, low_bits, n
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        self.zeros = 64 * np.arange(len(high) + 1) - self.ones
        self.wide = np.ndarray((len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))

    @staticmethod
    def write(values: np.ndarray, universe: int, folder: str, name: str) -> EliasFano:
        """Code ``values`` into two files and map them."""
        n = len(values)
        low_bits = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        values = values.astype(np.uint64)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = (universe >> low_bits) + n + 64
        bits = np.zeros((size + 63) // 64 * 64, np.uint8)
        bits[ones] = 1
        np.packbits(bits, bitorder="little").tofile(os.path.join(folder, name + ".high"))
        del bits, ones
        with open(os.path.join(folder, name + ".low"), "wb") as f:
            for i in range(0, n, 1 << 16):  # a multiple of eight values fills whole bytes
                part = values[i : i + (1 << 16)]
                lows = np.empty((len(part), low_bits), np.uint8)
                for b in range(low_bits):
                    lows[:, b] = (part >> np.uint64(b)) & np.uint64(1)
                f.write(np.packbits(lows.ravel(), bitorder="little").tobytes())
            f.write(bytes(16))
        low, high = (np.memmap(os.path.join(folder, f"{name}.{k}"), dtype=t, mode="r") for k, t in (("low", np.uint8), ("high", "<u8")))
        return EliasFano(low, high, low_bits, n)

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        return (self.wide[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        at = 64 * word + _select_in_word(np.asarray(self.high[word]), i - self.ones[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        k = high - 1  # the zero that closes the bucket before
        word = np.maximum(np.searchsorted(self.zeros, k, side="right") - 1, 0)
        at = 64 * word + _select_in_word(~np.asarray(self.high[word]), np.maximum(k - self.zeros[word], 0))
        return np.where(high > 0, at - k, 0)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the successor of each x if it equals x, else -1."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        target = x & np.uint64((1 << self.low_bits) - 1)
        at, stop = self._before(high), self._before(high + 1)
        active = np.flatnonzero(at < stop)
        while len(active):
            low = self._low(at[active])
            same = low == target[active]
            out[active[same]] = at[active[same]]
            active = active[low < target[active]]
            at[active] += 1
            active = active[at[active] < stop[active]]
        return out


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.round((log10 - _Q_LOW) / _Q_STEP), 0, 65535).astype("<u2")


def restore(q: np.ndarray) -> np.ndarray:
    return q * _Q_STEP + _Q_LOW


class Trie:
    """Words, their contexts and quantised numerators of one shard, in memory-mapped files."""

    def __init__(self, folder: str, words: np.ndarray, unigram: np.ndarray, word: np.ndarray, context: np.ndarray, numerator: np.ndarray):
        """``words`` sorted with log10 unigram probabilities; pairs sorted by rank of their word, then context."""
        words.tofile(os.path.join(folder, "words"))
        quantise(unigram).tofile(os.path.join(folder, "unigram"))
        quantise(numerator).tofile(os.path.join(folder, "numerator"))
        self.words, self.unigram, self.numerator = (
            np.memmap(os.path.join(folder, name), dtype=t, mode="r") if n else np.zeros(0, t)
            for name, t, n in (("words", "<u8", len(words)), ("unigram", "<u2", len(words)), ("numerator", "<u2", len(word)))
        )
        first = np.searchsorted(word, np.arange(len(words) + 1))
        self.pointers = EliasFano.write(first, len(word) + 1, folder, "pointers")
        relative = (word.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | context.astype(np.uint64)
        self.contexts = EliasFano.write(relative, max(1, len(words)) << CONTEXT_BITS, folder, "contexts")

    def rank(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, words)
        known = at < len(self.words)
        known[known] = self.words[at[known]] == words[known]
        return np.where(known, at, -1)

    def numerators(self, rank: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Quantised numerator of each (rank, context), -1 where the pair was not seen."""
        out = np.full(len(rank), -1, np.int64)
        ask = np.flatnonzero(rank >= 0)
        ask = ask[self.pointers.get(rank[ask]) < self.pointers.get(rank[ask] + 1)]  # words with contexts
        x = (rank[ask].astype(np.uint64) << np.uint64(CONTEXT_BITS)) | context[ask].astype(np.uint64)
        at = self.contexts.find(x)
        out[ask[at >= 0]] = self.numerator[at[at >= 0]]
        return out


# --- documents to tokens --------------------------------------------------------------------------------------------------


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and one end per text, the hash before each (a start at the front), and each token's text."""
    low = [t.lower() for t in texts]
    buffer, starts, lengths, owner = find_words(low)
    words = hash_words(buffer, starts, lengths)
    n, d = len(words), len(texts)
    per_text = np.bincount(owner, minlength=d)
    ends = np.cumsum(per_text + 1) - 1
    token, of = np.empty(n + d, np.uint64), np.repeat(np.arange(d), per_text + 1)
    token[np.arange(n) + owner] = words
    token[ends] = END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - per_text] = START
    return token, before, of


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list, np.ndarray]]:
    ids, train = batch.column("id").to_pylist(), ~np.array(batch.column("held_out").to_pylist(), dtype=bool)
    for first, run in blocks(raw_texts(batch.column("text")), BLOCK_BYTES):
        for i in range(0, len(run), BLOCK_DOCS):
            at = first + i
            part = run[i : i + BLOCK_DOCS]
            yield part, ids[at : at + len(part)], train[at : at + len(part)]


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((mix(h) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)


# --- step 1: totals and frequent words ------------------------------------------------------------------------------------

_COUNTS = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])


def _send_counts(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, _, train in _blocks(batch):
                token, _, of = tokens(texts)
                words, counts = np.unique(token[train[of]], return_counts=True)
                shard = _shard_of(words, shards)
                order = np.argsort(shard, kind="stable")
                bounds = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = []
                for s in np.unique(shard).tolist():
                    mine = order[bounds[s] : bounds[s + 1]]
                    rows.append((s, words[mine].tobytes(), counts[mine].astype("<u4").tobytes()))
                columns = zip(*rows, strict=True) if rows else [()] * len(_COUNTS)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)

    return run


def _count_shard(table: pa.Table) -> pa.Table:
    words = np.frombuffer(b"".join(table["words"].to_pylist()), "<u8")
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4").astype(np.int64)
    distinct, at = np.unique(words, return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    frequent = np.flatnonzero(total * 20 >= total.sum()) if len(total) else np.zeros(0, np.int64)  # twenty at most
    return pa.table(
        {
            "n": pa.array([int(total.sum())], pa.int64()),
            "v": pa.array([len(distinct)], pa.int64()),
            "words": pa.array([distinct[frequent].view(np.int64)], pa.list_(pa.int64())),
            "counts": pa.array([total[frequent]], pa.list_(pa.int64())),
        }
    )


# --- step 2: pairs to shards, sums per document ---------------------------------------------------------------------------

_PAIRS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("contexts_of", pa.binary()), ("contexts", pa.binary()),
     ("docs_of", pa.binary()), ("docs", pa.binary()), ("train", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_tokens", pa.binary())]
)
_PAIRS_DDL = (
    "shard int, block long, words binary, contexts_of binary, contexts binary, docs_of binary, docs binary, train binary, "
    "ids array<long>, n_tokens binary"
)


def _send_pairs(shards: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for texts, ids, train in _blocks(batch):
                token, before, of = tokens(texts)
                words, rank = np.unique(token, return_inverse=True)
                context = (before >> np.uint64(64 - CONTEXT_BITS)).astype(np.uint64)
                key = (rank.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | context
                order = np.argsort(key)
                key, doc = key[order], of[order].astype("<u2")
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                n_docs = np.diff(np.append(first, len(key)))
                pair_rank = (key[first] >> np.uint64(CONTEXT_BITS)).astype(np.int64)
                pair_context = (key[first] & np.uint64((1 << CONTEXT_BITS) - 1)).astype("<u4")
                shard_key = words.copy()
                hot = np.isin(words, frequent)
                pair_key = shard_key[pair_rank]
                spread = hot[pair_rank]
                pair_key[spread] ^= mix(pair_context[spread].astype(np.uint64))
                shard = _shard_of(pair_key, shards)
                pairs = np.argsort(shard, kind="stable")
                bounds = np.searchsorted(shard[pairs], np.arange(shards + 1))
                name = (task << 32) | block
                block += 1
                flags = np.packbits(train, bitorder="little").tobytes()
                rows = []
                for s in np.unique(shard).tolist():
                    mine = pairs[bounds[s] : bounds[s + 1]]
                    r = pair_rank[mine]
                    starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                    sizes = n_docs[mine]
                    ends = np.cumsum(sizes)
                    refs = np.arange(ends[-1]) + np.repeat(first[mine] - (ends - sizes), sizes)
                    rows.append(
                        (s, name, words[r[starts]].tobytes(), np.diff(np.append(starts, len(r))).astype("<u4").tobytes(),
                         pair_context[mine].tobytes(), sizes.astype("<u4").tobytes(), doc[refs].tobytes(), flags, None, None)
                    )
                n_tokens = np.bincount(of, minlength=len(texts)).astype("<i8").tobytes()
                rows.append((name % shards, name, None, None, None, None, None, flags, ids, n_tokens))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAIRS, strict=True)], schema=_PAIRS)

    return run


_SUMS = pa.schema(
    [("block", pa.int64()), ("docs", pa.binary()), ("score", pa.binary()), ("base", pa.binary()), ("known", pa.binary()),
     ("train", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_tokens", pa.binary())]
)
_SUMS_DDL = "block long, docs binary, score binary, base binary, known binary, train binary, ids array<long>, n_tokens binary"


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _score_shard(n: int, v: int, frequent: np.ndarray, frequent_counts: np.ndarray):
    z = float(n + v + 1)

    def run(table: pa.Table) -> pa.Table:
        is_ids = pa.compute.is_valid(table["n_tokens"])
        headers, sent = table.filter(is_ids), table.filter(pa.compute.invert(is_ids))
        out = [
            {"block": b, "train": t, "ids": i, "n_tokens": k}
            for b, t, i, k in zip(*(headers[c].to_pylist() for c in ("block", "train", "ids", "n_tokens")), strict=True)
        ]
        if sent.num_rows:
            flags = [np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little") for x in sent["train"].to_pylist()]
            base_of = np.concatenate(([0], np.cumsum([len(x) for x in flags])))
            train = np.concatenate(flags).astype(bool)
            refs_per_row = [len(x) // 2 for x in sent["docs"].to_pylist()]
            doc = _joined(sent["docs"], "<u2").astype(np.int32) + np.repeat(base_of[:-1].astype(np.int32), refs_per_row)
            sizes = _joined(sent["docs_of"], "<u4").astype(np.int64)
            word = np.repeat(_joined(sent["words"], "<u8"), _joined(sent["contexts_of"], "<u4"))
            context = _joined(sent["contexts"], "<u4")
            starts = np.cumsum(sizes) - sizes
            in_train = np.add.reduceat(train[doc].astype(np.int64), starts)
            # Distinct words and distinct pairs of the shard.
            words, rank = np.unique(word, return_inverse=True)
            key = (rank.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | context
            del word, context
            pairs, pair_of = np.unique(key, return_inverse=True)
            del key
            pair_of = pair_of.astype(np.int32)
            pair_count = np.bincount(pair_of, weights=in_train, minlength=len(pairs))
            count = np.bincount(rank, weights=in_train, minlength=len(words))
            hot = np.searchsorted(frequent, words)
            is_hot = hot < len(frequent)
            is_hot[is_hot] = frequent[hot[is_hot]] == words[is_hot]
            count[is_hot] = frequent_counts[hot[is_hot]]  # their pairs are spread over all shards
            # The trie holds what was seen in training.
            kept = np.flatnonzero(count > 0)
            new_rank = np.cumsum(count > 0) - 1
            pair_rank = (pairs >> np.uint64(CONTEXT_BITS)).astype(np.int64)
            pair_context = pairs & np.uint64((1 << CONTEXT_BITS) - 1)
            seen = np.flatnonzero(pair_count > 0)
            p1 = (count + 1) / z
            numerator = np.log10(pair_count[seen] + MU * p1[pair_rank[seen]])
            folder = tempfile.mkdtemp(prefix="trie-")
            try:
                trie = Trie(folder, words[kept], np.log10(p1[kept]), new_rank[pair_rank[seen]], pair_context[seen], numerator)
                at = trie.rank(words)
                unigram = np.full(len(words), np.log10(1 / z))
                unigram[at >= 0] = restore(trie.unigram[at[at >= 0]].astype(np.float64))
                found = trie.numerators(at[pair_rank], pair_context)
                del trie
            finally:
                shutil.rmtree(folder, ignore_errors=True)
            value = np.where(found >= 0, restore(found.astype(np.float64)), np.log10(MU) + unigram[pair_rank])
            value -= np.log10(count + MU)[pair_rank]  # this word as the context of the next token
            del found, numerator, seen, pair_context, pairs, pair_count, in_train
            of_pair = np.repeat(pair_of, sizes)
            m = len(train)
            score = np.bincount(doc, weights=value[of_pair], minlength=m)
            word_of = pair_rank[of_pair]
            base = np.bincount(doc, weights=np.log10(count + 1)[word_of], minlength=m)
            known = np.bincount(doc, weights=(count > 0)[word_of], minlength=m).astype("<u4")
            met = np.bincount(doc, minlength=m) > 0
            for b, a, e in zip(sent["block"].to_pylist(), base_of, base_of[1:], strict=False):
                here = np.flatnonzero(met[a:e])
                sums = {n: x[a:e][here].tobytes() for n, x in (("score", score), ("base", base), ("known", known))}
                out.append({"block": b, "docs": here.astype("<u2").tobytes(), **sums})
        return pa.Table.from_pylist(out, schema=_SUMS)

    return run


# --- step 3: documents ----------------------------------------------------------------------------------------------------


def _finish(n: int, v: int):
    z = np.log10(n + v + 1)

    def run(table: pa.Table) -> pa.Table:
        head = table.filter(pa.compute.is_valid(table["n_tokens"])).to_pylist()[0]
        d = len(head["ids"])
        n_tokens = np.frombuffer(head["n_tokens"], "<i8")
        score, base, known = np.zeros(d), np.zeros(d), np.zeros(d, np.int64)
        for docs, *sums in zip(*(table[c] for c in ("docs", "score", "base", "known")), strict=True):
            if docs.is_valid:
                at = np.frombuffer(docs.as_py(), "<u2")
                for total, part, kind in zip((score, base, known), sums, ("<f8", "<f8", "<u4"), strict=True):
                    total[at] += np.frombuffer(part.as_py(), kind).astype(total.dtype)
        train = np.unpackbits(np.frombuffer(head["train"], np.uint8), bitorder="little")[:d].astype(bool)
        return pa.table(
            {
                "id": pa.array(head["ids"], pa.int64()), "held_out": pa.array(~train), "n_tokens": pa.array(n_tokens),
                "n_known": pa.array(known), "train_tokens": pa.array(np.full(d, n, np.int64)), "base_score": pa.array(base - n_tokens * z),
                "score": pa.array(score),
            }
        )

    return run


# --- all steps ------------------------------------------------------------------------------------------------------------


def shard_sums(rows: DataFrame, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, int, int]:
    """Sums per shard and document of ``rows`` (id, text, held_out), and number and distinct number of training tokens."""
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2, round(size / 6.4 / shard_tokens))  # about one token in 6.4 bytes; any number is right
    sent = rows.mapInArrow(_send_counts(shards), "shard int, words binary, counts binary")
    totals = durable(sent.groupBy("shard").applyInArrow(_count_shard, "n long, v long, words array<long>, counts array<long>"))
    n, v = (x or 0 for x in totals.agg(F.sum("n"), F.sum("v")).first())
    often = totals.select(F.inline(F.arrays_zip("words", "counts"))).where(F.col("counts") * (4 * shards) >= n).collect()
    words = np.array([r["words"] for r in often], np.int64).view(np.uint64)  # four a shard at most
    counts = np.array([r["counts"] for r in often], np.int64)
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    pairs = rows.mapInArrow(_send_pairs(shards, words), _PAIRS_DDL)
    return pairs.groupBy("shard").applyInArrow(_score_shard(n, v, words, counts), _SUMS_DDL), n, v


def score_texts(
    docs: DataFrame, held_out_col, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (log10
    probability under the bigram model). Rows whose ``held_out_col`` expression is true are scored but not learnt from."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out_col.alias("held_out"))
    sums, n, v = shard_sums(rows, shard_tokens)
    return sums.groupBy("block").applyInArrow(
        _finish(n, v), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
