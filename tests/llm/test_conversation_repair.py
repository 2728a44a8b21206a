import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from selroute.llm import conversation_repair
from selroute.llm.queries import op13_rows

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def slow_search(rows):
    """(cost, audit, roles and rows) by listing every edit list of at most the cost of deleting all. A row is (role, truncated, must go)."""
    best = None
    limit = 2 * len(rows)
    stack = [(0, 0, "", "", ())]
    while stack:
        i, cost, audit, roles, made = stack.pop()
        if cost > limit or not re.fullmatch(r"(s?(ua)*u?)?", roles):
            continue
        if i == len(rows):
            if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, made)
        else:
            role, late, bad = rows[i]
            stack.append((i + 1, cost + 2, audit + "D", roles, made))
            if not bad:
                extra = 5 if late else 0
                if role:
                    stack.append((i + 1, cost + extra, audit + "K", roles + role[0], (*made, (i, role))))
                for new in ("user", "assistant"):
                    stack.append((i + 1, cost + 1 + extra, audit + "R", roles + new[0], (*made, (i, new))))
        for new in ("user", "assistant"):
            stack.append((i, cost + 5, audit + "I", roles + new[0], (*made, (None, new))))
    return best


def spaces(x):
    return " " if x is None else x


def slow_rows(table):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = spaces(role), spaces(text)
        kind = zlib.crc32(f"{spaces(conv)}:{spaces(turn)}".encode()) % 20
        rows = groups[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        counts, seen, plain = Counter(), set(), []
        for _, role, text in rows:
            shown = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            plain.append((role, fault == "truncated", fault in ("blank", "duplicate")))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, made = slow_search(plain)
        text = "\n".join(f"{role}:{rows[i][2] if i is not None else ''}" for i, role in made)
        yield (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversations(n, seed=1, most=6):
    rng = random.Random(seed)
    for conv in range(n):
        turn = rng.choice((None, 0, 1, 5))
        for k in range(rng.randrange(1, most + 1)):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", None, "")) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
            text = rng.choice(("Fine.", "Fine.", "What now?", "No énd", "", None, " \n\t", "Stop! ", "a", "long " * 40 + "end.\x0b"))
            yield conv, turn, role, text
            turn = rng.choice((None, 3)) if turn is None else turn + rng.choice((0, 1, 1, 1, 1, 4))


def test_search_equals_listing_all_edits():
    rng = random.Random(3)
    lower = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(400):
        codes = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randrange(0, 6)))
        rows = [(lower.get(c.lower(), "x"), c.isupper(), c == "x") for c in codes]
        assert conversation_repair._search(codes) == slow_search(rows)[:2]


def test_ties_take_the_first_letters_in_ascii_order():
    assert conversation_repair.cheapest_edits("") == (0, "")
    assert conversation_repair.cheapest_edits("uu") == (1, "KR")
    assert conversation_repair.cheapest_edits("s") == (2, "D")
    assert conversation_repair.cheapest_edits("UA") == (4, "DD")
    assert conversation_repair.cheapest_edits("uaa") == (2, "KDK")  # before KKD


def test_long_conversations_are_searched_in_whole():
    cost, audit = conversation_repair.cheapest_edits("s" + "ua" * 2000 + "x" + "oo" * 500)
    assert cost == 2 + 1000 and Counter(audit) == Counter({"K": 4001, "D": 1, "R": 1000})


def test_rows_match_brute_force(spark):
    table = list(conversations(160))
    table += [(None, 0, "user", "Hi there."), (None, 1, "assistant", "Hello."), (None, None, None, None)]
    table += [table[4], table[4], table[5]]  # repeated rows
    got = op13_rows(spark.createDataFrame(table, SCHEMA).repartition(3))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(slow_rows(table))


def test_clashing_names_empty_tables_and_vanished_conversations(spark):
    table = list(conversations(40, seed=8))
    gone = next(c for c in range(1000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table.append((gone, 0, "user", "Only row."))
    rows = spark.createDataFrame(table, SCHEMA)
    names = ("conv", "gone", "copy", "digest", "place", "code", "header", "edits", "audit", "seen", "pair", "own")
    crowded = rows.withColumns({n: F.lit(f"own {n}") for n in names})
    got = Counter(map(tuple, op13_rows(crowded).collect()))
    assert got == Counter(map(tuple, op13_rows(rows).collect())) == Counter(slow_rows(table))
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert op13_rows(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("rows", [3000])
def test_a_conversation_of_many_rows_streams_through(spark, rows):
    """One conversation holds nearly all rows; the repaired rows are legal, in order, and in one piece."""
    table = [(7, i, ("user", "assistant")[i % 2], f"Row {i}.") for i in range(rows)] + [(8, 0, "user", "Yes?"), (8, 1, "assistant", "No.")]
    judged, repaired = conversation_repair.repair(conversation_repair.damage(conversation_repair.plain_rows(spark.createDataFrame(table, SCHEMA))))
    out = [r for r in repaired.collect() if r.conv == 7]
    assert GOOD.fullmatch("".join(r.role[0] for r in out)) and [r.place for r in out] == list(range(len(out)))
    audit = judged.filter("conv = 7").first().audit
    assert "".join(r.edit for r in out) == audit.replace("D", "")
