"""Best thresholds on many balanced draws of the same rows, without ever writing a row per draw.

A draw takes, of every class, as many rows as the smallest class of the group has: those with the smallest md5 of ``seed-id``.

1. *Cuts.* The k-th smallest digest of n uniform ones lies near ``k / n``. Each task counts, per seed, the digests that are surely
   below and keeps those in a window around that place (a few standard deviations, so some multiple of the square root of n); what
   the windows hold together tells the k-th digest exactly. Should a window miss, it is widened and the step repeated.
2. *Scan.* The rows move once, sorted by falling value; the draws are flags of a vector as long as the list of seeds, held while a
   row streams by. Within a stretch of values the best threshold of a seed does not depend on what came before, since earlier
   rows add the same to all thresholds; so stretches are scanned on their own and give one row per seed, and a running sum over
   stretches picks the best.

Work is rows times seeds, so stretches are short and rows are dealt to a fixed number of partitions, however few bytes they
have. Groups are cut into stretches at the edges of a quantile sketch, as in ``ordering``. A value that holds a good part of a large group is a stretch of its own and its
rows are dealt to several tasks, whose sums are added.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selroute.operators.ordering import EDGE_FAN, ROWS_PER_BUCKET, attach, heavy_values, large_groups, with_value_bucket
from selroute.session import durable

MARGIN = 6.0  # standard deviations on each side of the expected place of the k-th digest
STRETCH_CELLS = 1 << 19  # rows times seeds a stretch of values is meant to have
_CELLS = 1 << 18  # digests computed at a time
_ONE_BLOCK = 55  # bytes of a message that md5 digests in one block
_MD5_CELLS = 1 << 14  # digests computed side by side
_BUFFER = 1 << 19  # window digests a task holds before it passes them on
_PART = ("__bucket", "__heavy", "__salt")


def _md5_rounds() -> list[tuple[int, int, int, int]]:
    """(function, word, turn, constant) of the 64 rounds of md5."""
    turns = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
    words = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)
    return [(i // 16, words[i // 16](i), turns[i // 16][i % 4], int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


_ROUNDS = _md5_rounds()
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_block(words: Sequence[np.ndarray], shape: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """The four state words of md5 for messages of one block; ``words`` are its 16 words, each of ``shape`` or broadcast to it."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for kind, k, turn, constant in _ROUNDS:
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, words[k] + np.uint32(constant), out=f)
        np.right_shift(f, np.uint32(32 - turn), out=g)
        np.left_shift(f, np.uint32(turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return tuple(x + np.uint32(start) for x, start in zip((a, b, c, d), _START, strict=True))


@lru_cache(maxsize=8)
def _heads(seeds: tuple[int, ...]) -> list[tuple[int, np.ndarray, list[bytes], np.ndarray]]:
    """(length, places, texts, words of a block) of the seeds whose text is equally long."""
    texts, out = [f"{s}-".encode() for s in seeds], []
    for length in sorted({len(t) for t in texts}):
        of = np.array([s for s, t in enumerate(texts) if len(t) == length])
        own = [texts[s] for s in of]
        out.append((length, of, own, np.frombuffer(b"".join(t.ljust(64, b"\0") for t in own), "<u4").reshape(-1, 16)))
    return out


def digests(ids: list[str], seeds: Sequence[int]) -> np.ndarray:
    """md5 of ``seed-id`` as two big-endian words, by id and seed.

    Messages of one block, up to 55 bytes, are digested many at a time; longer ones by themselves. Seeds whose text is equally long put the id at the
    same place, so a message is the words of its seed or-ed with those of its id."""
    tails = [i.encode() for i in ids]
    out = np.empty((len(tails), len(seeds), 2), np.uint64)
    size = np.array([len(t) for t in tails], np.int64)
    for length, of, heads, front in _heads(tuple(seeds)):
        short = np.flatnonzero(size + length <= _ONE_BLOCK)
        shared = -(-length // 4)  # words that the seed takes part in
        step = max(1, _MD5_CELLS // len(of))
        for i in range(0, len(short), step):
            rows = short[i : i + step]
            back = np.frombuffer(b"".join((b"\0" * length + tails[r] + b"\x80").ljust(64, b"\0") for r in rows), "<u4").reshape(-1, 16).copy()
            back[:, 14] = (size[rows] + length) * 8
            words = [back[:, k, None] | front[None, :, k] if k < shared else np.ascontiguousarray(back[:, k, None]) for k in range(16)]
            a, b, c, d = (x.byteswap().astype(np.uint64) for x in _md5_block(words, (len(rows), len(of))))
            out[rows[:, None], of[None, :], 0] = (a << np.uint64(32)) | b
            out[rows[:, None], of[None, :], 1] = (c << np.uint64(32)) | d
        for r in np.flatnonzero(size + length > _ONE_BLOCK).tolist():
            raw = b"".join([hashlib.md5(h + tails[r]).digest() for h in heads])
            out[r, of] = np.frombuffer(raw, ">u8").reshape(-1, 2)
    return out


def _at_most(found: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (found[..., 0] < high) | ((found[..., 0] == high) & (found[..., 1] <= low))


def _window(size: int, take: int, margin: float) -> tuple[int, int]:
    """First and last leading digest word that may belong to the ``take``-th of ``size`` digests."""
    spread = margin * np.sqrt(take * (1 - take / size)) + margin
    top = 1 << 64
    return max(0, int((take - spread) / size * top)), min(top - 1, int((take + spread) / size * top))


def _count_below(keys: Sequence[str], seeds: Sequence[int], margin: float, schema: pa.Schema):
    step = max(1, _CELLS // len(seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[tuple, np.ndarray] = {}
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def rows() -> pa.RecordBatch:
            """A row per class and seed that has something to say."""
            columns, parts = [[] for _ in schema], []
            for key, counts in below.items():
                found = held.get(key, [])
                of = np.concatenate([np.zeros(0, np.int64), *[o for o, _ in found]])
                words = np.concatenate([np.zeros((0, 2), np.uint64), *[w for _, w in found]])
                times = np.bincount(of, minlength=len(seeds))
                said = (counts > 0) | (times > 0)
                for column, v in zip(columns, key, strict=False):
                    column += [v] * int(said.sum())
                columns[-3] += np.array(seeds)[said].tolist()
                columns[-2] += counts[said].tolist()
                columns[-1] += times[said].tolist()
                parts.append(words[np.argsort(of, kind="stable")].astype(">u8").tobytes())
            raw = b"".join(parts)
            ends = np.arange(0, len(raw) + 1, 16, dtype=np.int32)
            inside = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            bounds = np.concatenate([[0], np.cumsum(columns[-1], dtype=np.int64)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(bounds), inside)
            plain = [pa.array(c, f.type) for c, f in zip(columns[:-1], list(schema)[:-1], strict=True)]
            return pa.RecordBatch.from_arrays([*plain, listed], schema=schema)

        for batch in batches:
            encoded = batch.column("__id").dictionary_encode()
            ids, code = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False)
            groups: dict[tuple, list[int]] = {}
            for r, key in enumerate(zip(*(batch.column(c).to_pylist() for c in [*keys, "__class", "__size", "__take"]), strict=True)):
                groups.setdefault(key, []).append(r)
            codes = {key: np.sort(code[own]) for key, own in groups.items()}
            for a in range(0, len(ids), step):
                digested = digests(ids[a : a + step], seeds)  # once for all groups an id belongs to
                for (*key, size, take), own in codes.items():
                    here = own[slice(*np.searchsorted(own, [a, a + step]))] - a
                    if not len(here):
                        continue
                    first, last = _window(size, take, margin)
                    found = digested[here]
                    lead = found[..., 0]
                    counts = below.setdefault(tuple(key), np.zeros(len(seeds), np.int64))
                    counts += (lead < np.uint64(first)).sum(axis=0)
                    at, of = np.nonzero((lead >= np.uint64(first)) & (lead <= np.uint64(last)))
                    held.setdefault(tuple(key), []).append((of, found[at, of]))
                    waiting += len(at)
                    if waiting > _BUFFER:
                        yield rows()
                        below, held, waiting = {}, {}, 0
        yield rows()

    return run


def _cuts(drawn: DataFrame, keys: Sequence[str], seeds: Sequence[int], margin: float = MARGIN) -> DataFrame:
    """(keys, __class, __cuts): for every class that is larger than what is taken of it, the last digest taken, seed by seed."""
    fields = [drawn.schema[k] for k in [*keys, "__class"]]
    out = T.StructType([*fields, T.StructField("seed", T.LongType()), T.StructField("below", T.LongType()), T.StructField("inside", T.ArrayType(T.BinaryType()))])
    arrow = drawn.select(*keys, "__class").limit(0).toArrow().schema
    schema = pa.schema([*arrow, ("seed", pa.int64()), ("below", pa.int64()), ("inside", pa.list_(pa.binary()))])
    larger = drawn.where("__size > __take")
    sizes = larger.groupBy(*keys, "__class").agg(F.max("__take").alias("__take"))
    narrow = larger.select(*keys, "__class", "__size", "__take", "__id").repartition(_partitions(drawn), "__id").sortWithinPartitions("__id")
    counted = narrow.mapInArrow(_count_below(keys, list(seeds), margin, schema), out)
    seen = counted.groupBy(*keys, "__class", "seed").agg(
        F.sum("below").alias("below"), F.array_sort(F.flatten(F.collect_list("inside"))).alias("inside")
    )
    rank = F.col("__take") - F.col("below")
    cut = F.when(rank > 0, F.get("inside", (rank - 1).cast("int")))
    found = durable(seen.join(sizes, [*keys, "__class"]).select(*keys, "__class", "seed", cut.alias("cut")))
    if not found.where("cut IS NULL").isEmpty():
        return _cuts(drawn, keys, seeds, margin * 8)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seed", "cut"))), lambda x: x["cut"])
    return found.groupBy(*keys, "__class").agg(ordered.alias("__cuts"))


class _Scan:
    """State of one stretch of values, for all seeds at once."""

    def __init__(self, n: int):
        # By seed: positives less negatives so far, rows so far, and rows in front of the current value.
        self.net, self.seen, self.ahead = (np.zeros(n, np.int64) for _ in range(3))
        self.pos, self.neg = (np.zeros(n, np.int64) for _ in range(2))
        self.best, self.threshold = np.full(n, np.iinfo(np.int64).min), np.zeros(n)
        self.top = self.value = None

    def add(self, values: np.ndarray, sign: np.ndarray, kept: np.ndarray) -> None:
        """Rows by falling value, with +1 or -1 by class and whether each seed draws them."""
        step = kept * sign[:, None]
        net = np.concatenate([self.net[None], self.net + np.cumsum(step, axis=0)])
        seen = np.concatenate([self.seen[None], self.seen + np.cumsum(kept, axis=0)])
        before = np.concatenate(([np.nan if self.value is None else self.value], values[:-1]))
        ends = np.flatnonzero((before != values) & ~np.isnan(before))  # a value is complete in front of these rows
        self._offer(net[ends], seen[ends], before[ends])
        if self.top is None:
            self.top = values[0]
        self.value, self.net, self.seen = values[-1], net[-1], seen[-1]
        self.pos += (step > 0).sum(axis=0)
        self.neg += (step < 0).sum(axis=0)

    def _offer(self, net: np.ndarray, seen: np.ndarray, thresholds: np.ndarray) -> None:
        """Take complete values into account; for a seed only those that it drew a row of."""
        if len(net):
            drawn = np.diff(np.concatenate([self.ahead[None], seen]), axis=0) > 0
            net = np.where(drawn, net, np.iinfo(np.int64).min)
            last = len(net) - 1 - np.argmax(net[::-1], axis=0)  # of equal ones the lowest threshold
            most = net[last, np.arange(net.shape[1])]
            better = (most >= self.best) & drawn.any(axis=0)
            self.best[better], self.threshold[better] = most[better], thresholds[last][better]
            self.ahead = seen[-1]

    def finish(self) -> None:
        self._offer(self.net[None], self.seen[None], np.array([self.value]))


def _scan(part: Sequence[str], seeds: Sequence[int], schema: pa.Schema):
    """Rows come sorted by part, the cuts in front, then by falling value."""
    step = max(1, _CELLS // len(seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, cuts, state = None, {}, _Scan(len(seeds))

        def result() -> pa.RecordBatch:
            state.finish()
            drew = np.flatnonzero(state.seen)  # a seed may draw nothing of a stretch
            columns = [[v] * len(drew) for v in here]
            columns += [np.array(seeds)[drew], [float(state.top)] * len(drew)]
            columns += [x[drew] for x in (state.best, state.threshold, state.pos, state.neg)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            change = np.zeros(batch.num_rows, bool)
            change[:1] = True
            for c in (*part, "__class", "__head"):
                code = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            starts = [*np.flatnonzero(change).tolist(), batch.num_rows]
            ids, values = batch.column("__id"), batch.column("__v").to_numpy(zero_copy_only=False)
            todo: list[tuple[int, int, int]] = []

            def flush() -> None:
                """Add the runs of rows that wait, in order; a run is of one class."""
                while todo:
                    taken, size = [], 0
                    while todo and size < step:
                        a, b, c = todo.pop(0)
                        if size + b - a > step:
                            todo.insert(0, (a + step - size, b, c))
                            b = a + step - size
                        taken.append((a, b, c))
                        size += b - a
                    first, last = taken[0][0], taken[-1][1]
                    kept, own = np.ones((last - first, len(seeds)), np.int8), np.repeat([c for _, _, c in taken], [b - a for a, b, _ in taken])
                    for c, cut in cuts.items():  # the rows of a class are digested together, however they alternate
                        at = np.flatnonzero(own == c)
                        if len(at):
                            kept[at] = _at_most(digests(ids.take(pa.array(at + first)).to_pylist(), seeds), *cut)
                    sign = np.where(own == 1, 1, -1).astype(np.int8)
                    state.add(values[first:last], sign, kept)

            for a, b in zip(starts, starts[1:], strict=False):
                key = tuple(batch.column(c)[a].as_py() for c in part)
                if key != here:
                    flush()
                    if state.top is not None:
                        yield result()
                    here, cuts, state = key, {}, _Scan(len(seeds))
                c = batch.column("__class")[a].as_py()
                if batch.column("__head")[a].as_py():
                    words = np.frombuffer(b"".join(batch.column("__cuts")[a].as_py()), ">u8").astype(np.uint64).reshape(-1, 2)
                    cuts[c] = (words[:, 0], words[:, 1])
                else:
                    todo.append((a, b, c))
            flush()
        if state.top is not None:
            yield result()

    return run


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _placed(rows: DataFrame, keys: Sequence[str], rows_per_bucket: int) -> DataFrame:
    """Add the stretch of every row: bucket (about ``rows_per_bucket`` rows, by falling value), heavy value and salt."""
    none = {"__bucket": F.lit(0).cast("long"), "__heavy": F.lit(None).cast("double"), "__salt": F.lit(0)}
    large = large_groups(rows, keys, rows_per_bucket)
    if large is None:
        return rows.withColumns(none)
    placed = with_value_bucket(rows, keys, "__v", True, large, rows_per_bucket)
    # Edges of the sketch are taken together where there are more of them than stretches.
    wanted = F.least(F.ceil(F.col("__rows") / rows_per_bucket), F.lit(EDGE_FAN**2))
    joined = F.floor(F.col("__bucket") / F.ceil(EDGE_FAN**2 / wanted)).cast("long")
    placed = attach(placed, large, keys, ["__id"], "left").withColumn("__bucket", F.coalesce(joined, "__bucket")).drop("__rows")
    heavy = heavy_values(rows, keys, "__v", large, rows_per_bucket)
    if heavy is None:
        return placed.withColumns({k: none[k] for k in ("__heavy", "__salt")})
    marked = attach(placed, heavy, [*keys, "__v"], ["__id"], "left")
    salt = F.coalesce(F.pmod(F.xxhash64("__id"), F.col("__cuts")).cast("int"), F.lit(0))
    return marked.withColumns({"__heavy": F.when(F.col("__cuts").isNotNull(), F.col("__v")), "__salt": salt}).drop("__cuts")


def _ascending(column: Column) -> Column:
    return column.asc_nulls_first()


def balanced_sweeps(
    rows: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    seeds: Sequence[int],
    value: str = "value",
    label: str = "label",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(keys, seed, threshold, accuracy): the cut ``value >= threshold`` that is right most often on the balanced sample of every
    seed; the lowest threshold wins a tie. Rows without label or key take no part; rows without a value are drawn but not cut."""
    keys, seeds = list(keys), sorted(set(seeds))
    base = rows.where(F.col(label).isNotNull()).select(
        *keys, F.col(label).cast("long").alias("__class"), F.col(value).cast("double").alias("__v"),
        F.concat_ws("-", *[F.col(i).cast("string") for i in ids]).alias("__id"),
    )
    for k in keys:
        base = base.where(F.col(k).isNotNull())
    # Sizes and the least of them: a row per class.
    per_class = base.groupBy(*keys, "__class").agg(F.count(F.lit(1)).alias("__size"))
    sizes = durable(per_class.withColumn("__take", F.min("__size").over(Window.partitionBy(*keys))))
    cuts = durable(_cuts(attach(base, sizes, [*keys, "__class"], ["__id"]), keys, seeds))
    stretch_rows = max(1, min(rows_per_bucket, STRETCH_CELLS // max(1, len(seeds))))
    placed = _placed(base.where("__v IS NOT NULL AND NOT isnan(__v)"), keys, stretch_rows)
    part = [*keys, *_PART]
    parts = placed.select(*part).distinct()
    heads = cuts.join(parts, keys) if keys else cuts.join(parts)
    body = placed.select(*part, F.lit(False).alias("__head"), "__class", "__v", "__id", F.lit(None).cast("array<binary>").alias("__cuts"))
    heads = heads.select(
        *part, F.lit(True).alias("__head"), "__class", F.lit(None).cast("double").alias("__v"), F.lit(None).cast("string").alias("__id"), "__cuts"
    )
    met = heads.unionByName(body).repartition(_partitions(rows), *part)
    ordered = met.sortWithinPartitions(*map(_ascending, map(F.col, part)), F.desc("__head"), F.desc("__v"))
    arrow = met.select(*part).limit(0).toArrow().schema
    names = (("seed", pa.int64(), T.LongType()), ("top", pa.float64(), T.DoubleType()), ("best", pa.int64(), T.LongType()),
             ("threshold", pa.float64(), T.DoubleType()), ("pos", pa.int64(), T.LongType()), ("neg", pa.int64(), T.LongType()))
    out = T.StructType([*[met.schema[k] for k in part], *[T.StructField(n, t) for n, _, t in names]])
    scanned = ordered.mapInArrow(_scan(part, seeds, pa.schema([*arrow, *[(n, a) for n, a, _ in names]])), out)
    stretch = scanned.groupBy(*keys, "__bucket", "__heavy", "seed").agg(
        F.max("top").alias("top"), F.sum("best").alias("best"), F.max("threshold").alias("threshold"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    ahead = Window.partitionBy(*keys, "seed").orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("pos") - F.col("neg")).over(ahead), F.lit(0))
    best = F.max(F.struct((F.col("best") + F.col("offset")).alias("net"), (-F.col("threshold")).alias("low")))
    chosen = stretch.withColumn("offset", offset).groupBy(*keys, "seed").agg(best.alias("b"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    accuracy = (F.col("b.net") + F.col("neg")) / (F.col("pos") + F.col("neg"))
    return chosen.select(*keys, F.col("seed").cast("int").alias("seed"), (-F.col("b.low")).alias("threshold"), accuracy.alias("accuracy"))
