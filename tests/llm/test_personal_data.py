import hashlib
import random
import re

import pytest

from selroute.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    for alphabet in ("ab1209@@..+-  ()%é", "0123456789 -", "+123 ()", "12.345."):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert pii.find_spans(text) == brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("to jane at mail dot example dot com please", "email", "jane at mail dot example dot com"),
        ("jean arobase exemple point fr", "email", "jean arobase exemple point fr"),
        ("an juan.42 arroba ejemplo punto com.", "email", "juan.42 arroba ejemplo punto com"),
        ("see jane.doe@example[.]com now", "email", "jane.doe@example[.]com"),
        ("see jane@example dot com now", "email", "jane@example dot com"),
        ("see jane {at} example {dot} co {dot} uk now", "email", "jane {at} example {dot} co {dot} uk"),
        ("see Jane DOT Doe AT example DOT com now", "email", "Jane DOT Doe AT example DOT com"),
        ("plus eins neun acht acht fünf fünf fünf zwei vier acht fünf", "phone", "plus eins neun acht acht fünf fünf fünf zwei vier acht fünf"),
        ("user(at)mail.example.com", "email", "user(at)mail.example.com"),
        ("x јоhn@exаmple.com y", "email", "јоhn@exаmple.com"),
        ("x john＠example．com y", "email", "john＠example．com"),
        ("ip 192[.]168[.]1[.]1 up", "ip", "192[.]168[.]1[.]1"),
        ("ip one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
        ("no ４３８７５１３０３５２３７２６９.", "card", "４３８７５１３０３５２３７２６９"),
        ("no 4387​5130 3523-7269.", "card", "4387​5130 3523-7269"),
        ("four three eight seven five one three zero three five two three seven two six nine", "card",
         "four three eight seven five one three zero three five two three seven two six nine"),
        ("call plus one nine eight eight five five five two four eight five!", "phone", "plus one nine eight eight five five five two four eight five"),
        ("call +1 (nine eight eight) 555-2485 now", "phone", "+1 (nine eight eight) 555-2485"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    added = pii.disguised_spans(text, pii.find_spans(text))
    assert [text[a:b] for a, b in added[kind]] == [found]
    assert not any(added[k] for k in added if k != kind)


@pytest.mark.parametrize(
    "found", ["jane at gmail.com", "jane at corp.com", "bob99 at mail.example.org", "jane at\ncorp dot com", "jane.doe at \r\n gmail.com", "Ana AT correo.es"]
)
def test_a_bare_at_before_a_plain_domain(found):
    text = f"write to {found}, please"
    assert [text[a:b] for a, b in pii.disguised_spans(text, pii.find_spans(text))["email"]] == [found]


@pytest.mark.parametrize(
    "text", ["more at example.com now", "tickets available at shop.org", "look at www.example.com", "prices at example.com/shop today", "hosted at example.net:80",
             "we met at\nnoon.de", "details at page.one", "found at site.de.", "he arrived at once.it was late"],
)
def test_pointers_to_pages_are_no_addresses(text):
    base = pii.find_spans(text)
    assert not any(pii.disguised_spans(text, base).values())


@pytest.mark.parametrize(("kind", "found"), [("ip", "192.168.0.one"), ("phone", "+49 30 1234 five 678"), ("card", "4387 5130 3523 726 nine")])
def test_a_single_spelled_digit_counts_beside_digits(kind, found):
    text = f"see {found} there"
    assert [text[a:b] for a, b in pii.disguised_spans(text, pii.find_spans(text))[kind]] == [found]


@pytest.mark.parametrize("ending", ["online", "cloud", "site", "shop", "xyz", "pro", "tech", "agency", "museum", "com", "de"])
@pytest.mark.parametrize("start", ["jane.doe at mail dot ", "bob at firm dot ", "Bob AT shop.firm DOT "])
def test_a_written_dot_takes_any_ending(start, ending):
    text = f"write to {start}{ending} today"
    assert [text[a:b] for a, b in pii.disguised_spans(text, pii.find_spans(text))["email"]] == [start + ending]


@pytest.mark.parametrize("text", ["we stared at the dot there", "look at one dot here", "she pointed at every dot above", "they met at noon dot then left", "bob at firm.cloud", "he laughed at that dot dot dot thing"])
def test_unknown_endings_in_prose_get_no_spans(text):
    assert not any(pii.disguised_spans(text, pii.find_spans(text)).values())


@pytest.mark.parametrize("text", ["look at the end. Then at two. One", "we met at noon dot", "one of six or two", "plus one", "", "a@b", "at dot com", "look at this dot there", "word at the point of it", "us at www.example.com"])
def test_ordinary_text_gets_no_spans(text):
    base = pii.find_spans(text)
    assert not any(base.values()) and not any(pii.disguised_spans(text, base).values())


def test_base_spans_stay_beside_added_ones():
    text = "a@b.co and x [at] y [dot] org"
    base = pii.find_spans(text)
    assert base["email"] == [(0, 6)]
    assert pii.disguised_spans(text, base)["email"] == [(11, len(text))]
    assert pii.masked(text, "email:0:6,email:11:29") == "[EMAIL] and [EMAIL]"


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "+" * 300_000, "@" * 300_000, "1." * 150_000, "one " * 60_000):
        pii.disguised_spans(text, pii.find_spans(text))


def test_clashing_names_change_nothing(messy, crowded):
    assert sorted(map(str, pii.find_pii(crowded).collect())) == sorted(map(str, pii.find_pii(messy).collect()))


def test_table(spark, messy, nothing):
    rows = pii.find_pii(messy.unionByName(spark.createDataFrame([(900, "é a@b.co 1.2.3.4", "", "", 1)], messy.schema))).collect()
    assert len(rows) == messy.count() + 1
    found = next(r for r in rows if r.id == 900)
    assert (found.n_email, found.n_ip, found.spans) == (1, 1, "email:2:8,ip:9:16")
    assert found.base_sha256 == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest()
    assert next(r for r in rows if r.id == 301).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(nothing).count() == 0
