"""Cheapest repair of the turn structure of conversations.

The rows of a conversation are taken by turn (nulls first; rows of one turn by role, then digest of their text). A row's first
fault counts: blank (nothing but ASCII white space), duplicate (role and text seen earlier in the conversation) or truncated (the
last visible character is none of ``.!?``). Edits: Keep (0), Rerole to user or assistant (1), Delete (2; blank and duplicate rows
have to go), Insert an empty user or assistant row (5); a truncated row that stays adds 5. The roles left, by their initials, have
to read ``(s?(ua)+)?``. Of the cheapest edits those whose initials come first in ASCII order are taken.

The search is a shortest path over a small graph whose nodes are (rows read, last role kept). Its weights are single integers:
the high digits hold the cost, and below them one octal digit per edit holds the audit letters from the front, ``D < I < K < R`` as
1 to 4, with zeros after the last one, so the smaller integer is the cheaper edit list and, at equal cost, the one whose letters
come first (a list comes before its own extensions). Putting an edit in front adds its cost, shifts the letters by one digit and
sets the first; the path is found from the last row back by integer minima alone.

On Spark: rows are marked in two windows over one shuffle that carries digests in place of texts. Per conversation only one letter
a row is gathered (the audit, which is part of the result, is as long). Texts are shuffled once, sorted after the conversation's
audit, and rewritten as a stream, so a task holds a batch of rows and one audit, whatever the length of a conversation.

Defined cases: null roles and texts are one space, a null conversation is a conversation of its own; null turns come first and
count for no gap; a role that is empty has no initial and can't be kept; repeated rows are duplicates; an empty table gives an
empty result; only the four columns named are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selroute.session import durable

WHITE_SPACE = " \t\n\x0b\f\r"
# Costs of the edits and the digit of their initials.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_LETTER = {v: k for k, v in _DIGIT.items()}

# A row in one letter: its role by the first character (s, u, a or other), upper case where truncated; x has to be deleted.
_CODES = "suaoSUAOx"
# What may follow: state -> role -> next state.
_FOLLOWS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
_STATES = ("", "s", "u", "a")
ROLE_OF = {"u": "user", "a": "assistant"}


# --- one conversation -----------------------------------------------------------------------------------------------------


def cheapest_edits(codes: str) -> tuple[int, str]:
    """Cost and audit letters of the repair of a conversation, one code a row."""
    return _remembered(codes) if len(codes) <= 32 else _search(codes)


def _search(codes: str) -> tuple[int, str]:
    n = len(codes)
    width = 3 * (n + 2 * n // 5 + 4)  # no cheapest list of edits is longer than this many digits
    low = (1 << width) - 1
    top = width - 3

    def before(letter: str, cost: int, rest: int | None) -> int | None:
        """Weight of an edit put in front of ``rest``."""
        if rest is None:
            return None
        return ((rest >> width) + cost) << width | _DIGIT[letter] << top | (rest & low) >> 3

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    def with_inserts(value: dict[str, int | None]) -> dict[str, int | None]:
        """An inserted row leads to another state at the same place; more than two in a row never pay."""
        u = least(value["u"], before("I", INSERT, value["a"]))
        a = least(value["a"], before("I", INSERT, value["u"]))
        return {"": least(value[""], before("I", INSERT, u)), "s": least(value["s"], before("I", INSERT, u)), "u": u, "a": a}

    value = with_inserts({"": 0, "s": None, "u": None, "a": 0})
    for code in reversed(codes):
        role, extra = code.lower(), TRUNCATED if code.isupper() else 0
        here = {}
        for state in _STATES:
            choices = [before("D", DELETE, value[state])]
            if code != "x":
                follows = _FOLLOWS[state]
                if role in follows:
                    choices.append(before("K", KEEP + extra, value[follows[role]]))
                choices += [before("R", REROLE + extra, value[follows[r]]) for r in "ua" if r in follows]
            here[state] = least(*choices)
        value = with_inserts(here)
    best = value[""]
    letters = []
    for at in range(top, -1, -3):
        digit = (best >> at) & 7
        if not digit:
            break
        letters.append(_LETTER[digit])
    return best >> width, "".join(letters)


_remembered = lru_cache(maxsize=1 << 16)(_search)


def edits_column(codes: Column) -> Column:
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [cheapest_edits(c) for c in batch.to_pylist()]
            columns = [pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.StructArray.from_arrays(columns, ["cost", "audit"])

    return F.arrow_udf(compute, "struct<cost:bigint,audit:string>")(codes)


def _step(state: str, letter: str, role: str) -> tuple[str, str | None]:
    """Next state, and the role of the row that comes out (None: no row)."""
    if letter == "D":
        return state, None
    if letter == "K":
        return role[0], role
    new = "a" if state == "u" else "u"  # a system row is never made
    return new, ROLE_OF[new]


# --- rows -----------------------------------------------------------------------------------------------------------------


def plain_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as (conv, turn, role, text, gone): nulls of role and text as one space, no row gone."""
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))],
        F.lit(False).alias("gone"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """Damage one row in four, by the crc32 of ``conversation:turn``: dropped (marked as gone), emptied, without its end marks,
    repeated, or given to the user."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn"))
    name = F.concat(conv, F.lit(":"), turn)
    kind = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("gone") | (kind == 0)).alias("gone"), times.alias("copy"))


def _order() -> list:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def marked(rows: DataFrame) -> DataFrame:
    """Each row with its place in the conversation, its fault and its code. Texts stay behind: a digest stands for them."""
    visible = F.rtrim("text", F.lit(WHITE_SPACE))
    ends = F.substring(visible, -1, 1).isin(".", "!", "?")
    slim = rows.select(
        "conv", "turn", "role", "gone", F.unhex(F.md5("text")).alias("digest"), (visible == "").alias("blank"), (~ends).alias("open")
    )
    inside = Window.partitionBy("conv", "gone").orderBy(*_order())
    same = Window.partitionBy("conv", "gone", "role", "digest").orderBy("turn")
    initial = F.substring("role", 1, 1)
    placed = slim.withColumn("seen", F.row_number().over(same) > 1).select(
        "*",
        F.row_number().over(inside).alias("place"),
        F.coalesce(F.concat(F.lag(initial).over(inside), initial), F.lit("su")).alias("pair"),
        F.lag("turn").over(inside).alias("turn_before"),
    )
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("open"), "truncated")
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(code)).otherwise(code)
    return placed.withColumns({"fault": fault, "code": code})


def judge(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost (longs) and audit. Rows that are gone only keep
    their conversation in the result."""
    rows = marked(rows)
    here = ~F.col("gone")

    def how_many(condition: Column) -> Column:
        return F.sum(F.when(here & condition, 1).otherwise(0)).cast("long")

    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    turns = [f(F.when(here, F.col("turn"))) for f in (F.max, F.min)]
    letters = F.array_sort(F.collect_list(F.when(here, F.struct("place", "code"))))
    judged = rows.groupBy("conv").agg(
        F.coalesce(turns[0] - turns[1] + 1 - how_many(new_turn), F.lit(0)).cast("long").alias("gaps"),
        *[how_many(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        how_many(~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
        F.array_join(F.transform(letters, lambda x: x["code"]), "").alias("codes"),
    )
    return judged.withColumn("edits", edits_column(F.col("codes"))).select("*", "edits.*").drop("edits", "codes")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation, the audit first. Yields the repaired rows in order, with the letter that made them."""
    names = ["conv", "place", "edit", "role", "text"]
    conv, audit, at, state, place = None, "", 0, "", 0
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])

        def put(letter: str, role: str, text: str) -> None:
            nonlocal state, at, place
            state, made = _step(state, letter, role)
            at += 1
            if made is not None:
                for column, value in zip(out, (conv, place, letter, made, text if letter != "I" else ""), strict=True):
                    column.append(value)
                place += 1

        def inserts() -> None:
            while at < len(audit) and audit[at] == "I":
                put("I", "", "")

        columns = (batch.column(c).to_pylist() for c in ("conv", "header", "role", "text"))
        for here, header, role, text in zip(*columns, strict=True):
            if header is not None:
                conv, audit, at, state, place = here, header, 0, "", 0
            else:
                put(audit[at], role, text)
            inserts()  # those before the next row, or after the last one
        kinds = (batch.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def repaired_rows(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text) of the rows after the repair that ``judged`` (conv, audit) says. A conversation lies in one
    partition, in order."""
    null_text = F.lit(None).cast("string")
    heads = judged.select(
        "conv", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.col("audit").alias("header"), null_text.alias("role"),
        null_text.alias("text"), F.lit(None).cast("binary").alias("digest"),
    )
    body = rows.filter("not gone").select(
        "conv", "turn", null_text.alias("header"), "role", "text", F.unhex(F.md5("text")).alias("digest")
    )
    dealt = heads.unionByName(body).repartition("conv")
    in_order = dealt.sortWithinPartitions("conv", F.col("header").isNull(), *_order()).select("conv", "header", "role", "text")
    conv_type = rows.schema["conv"].dataType.simpleString()
    return in_order.mapInArrow(_rewrite, f"conv {conv_type}, place long, edit string, role string, text string")


def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ``role:text`` lines of each conversation, joined by newlines. Rows come in order, a conversation in one piece."""
    conv, digest = None, None
    for batch in batches:
        done: tuple[list, list] = ([], [])
        columns = (batch.column(c).to_pylist() for c in ("conv", "place", "role", "text"))
        for here, place, role, text in zip(*columns, strict=True):
            line = f"{role}:{text}".encode()
            if place == 0:
                if digest is not None:
                    done[0].append(conv)
                    done[1].append(digest.hexdigest())
                conv, digest = here, hashlib.sha256(line)
            else:
                digest.update(b"\n" + line)
        yield pa.RecordBatch.from_arrays([pa.array(done[0], batch.schema.field("conv").type), pa.array(done[1], pa.string())], ["conv", "sha256"])
        kind = batch.schema.field("conv").type
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], ["conv", "sha256"])


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) of every conversation of ``repaired_rows`` that has a row."""
    conv_type = repaired.schema["conv"].dataType.simpleString()
    return repaired.mapInArrow(_hash_stream, f"conv {conv_type}, sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with every conversation of ``rows`` (see ``plain_rows``) and how it is mended, and the mended rows."""
    judged = durable(judge(rows))
    return judged, repaired_rows(rows, judged)
