"""Exact duplicates through a two-pass Bloom filter, in DataFrame operations only.

Pass one counts filter slots (two per text digest) and keeps the slots that were hit twice as a bitmap. Pass two tests
every row against the bitmap: a row with a slot that was hit once has no copy and passes straight through. Only the rest
is shuffled by digest. A false positive costs a shuffled row, never a wrong result.

The bitmap has 16 bits per row, at most ``max_bits`` (2**28 bits are 32 MB), which is the proven bound of what is broadcast.
Beyond that bound a larger share of rows takes the shuffled path; results stay the same.

Defined cases: a null text counts as empty; a null id loses to any other id; rows that repeat id and text are one
document (all are marked alike, and ``deduplicate`` returns one of them); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selroute.llm.common import free_name
from selroute.session import durable

WHITE_SPACE = r"[\x20\x09-\x0D]+"
BITS_PER_ROW = 16
MAX_BITS = 1 << 28


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _digest(column: str) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(_text(column), WHITE_SPACE, ""), 256))


def _slots(digest: Column, bits: int) -> list[Column]:
    """One slot in each half of the filter, counted from 1."""
    half = bits // 2
    return [F.pmod(F.xxhash64(digest), F.lit(half)) + 1, F.pmod(F.xxhash64(digest, F.lit(7)), F.lit(half)) + half + 1]


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, 1 << max(16, (BITS_PER_ROW * rows - 1).bit_length()))


def slot_bitmap(digests: DataFrame, bits: int, hits: int = 2) -> DataFrame:
    """(bucket, bitmap) of the slots that at least ``hits`` rows of ``digests`` hit; at most ``bits / 8`` bytes in all."""
    slots = digests.select(F.explode(F.array(*_slots(F.col("digest"), bits))).alias("slot"))
    often = slots.groupBy("slot").agg(F.count("*").alias("hits")).filter(F.col("hits") >= hits)
    return often.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    )


def with_suspicion(rows: DataFrame, digest: str, bitmap: DataFrame, bits: int, name: str) -> DataFrame:
    """Add a boolean: both slots of the row's digest are set."""
    table = F.broadcast(durable(bitmap))
    tests = []
    for k, slot in enumerate(_slots(F.col(digest), bits)):
        bucket, held = f"{name}_bucket{k}", f"{name}_bitmap{k}"
        part = table.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(held))
        rows = rows.join(part, F.bitmap_bucket_number(slot) == F.col(bucket), "left")
        position = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substr(F.col(held), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        tests.append(F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False)))
    return rows.withColumn(name, tests[0] & tests[1]).drop(*[f"{name}_{c}{k}" for c in ("bucket", "bitmap") for k in (0, 1)])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary SHA-256 of the text without white space)."""
    keyed = durable(
        docs.select(
            F.col(id_col).alias("id"), F.char_length(_text(text_col)).cast("long").alias("points"), _digest(text_col).alias("digest")
        )
    )
    bits = filter_bits(keyed.count(), max_bits)
    tested = durable(with_suspicion(keyed, "digest", slot_bitmap(keyed, bits), bits, "suspect"))
    alone = tested.filter("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    suspects = tested.filter("suspect").select("id", "points", "digest")
    groups = durable(
        suspects.groupBy("digest").agg(
            F.count("*").alias("group_size"), F.max(F.struct("points", (-F.col("id")).alias("minus_id"))).alias("best")
        )
    ).select("digest", "group_size", (-F.col("best.minus_id")).alias("keep_id"))
    grouped = suspects.join(groups, "digest").select("id", "keep_id", "group_size", "digest")
    return alone.unionByName(grouped).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows that stay, with all their columns. Rows without a copy are not shuffled; of each group of copies every task
    sends one row at most, so a group of any size meets in a small aggregate."""
    names = docs.columns
    digest, suspect, row = (free_name(x, names) for x in ("digest", "suspect", "row"))
    keyed = durable(docs.select(_digest(text_col).alias("digest")))
    bits = filter_bits(keyed.count(), max_bits)
    rows = with_suspicion(docs.withColumn(digest, _digest(text_col)), digest, slot_bitmap(keyed, bits), bits, suspect)
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    best = F.struct(F.char_length(_text(text_col)), -F.col(id_col), _text(text_col))
    grouped = rows.filter(F.col(suspect)).groupBy(digest).agg(F.max_by(whole, best).alias(row))
    return rows.filter(~F.col(suspect)).select(*[F.col(f"`{c}`") for c in names]).unionByName(grouped.select(f"{row}.*"))
