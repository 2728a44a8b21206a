"""Personal data in texts, also where it is disguised, with spans in the characters of the source text.

A text runs through transducers that undo disguises: look-alike characters, spelled digits, and written "at" and "dot". Each
one returns a tape: the rewritten text and, for every rewritten stretch, where it came from. The identifier patterns run on
the source text (base spans) and on the last tape; spans found there are mapped back stage by stage. A mapped span is added
only if it covers something a transducer changed and overlaps no base span of its kind, so base spans always stay.

Defined cases: a null text counts as empty and has no spans; offsets are code points, ends are exclusive; a span whose kind
check fails (parts above 255, Luhn, number of digits) is dropped without a retry.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A digit run either fits from its first digit or not at all, so no other start needs a try.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m.group().split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                yield m.span()


_FINDERS = dict(zip(KINDS, (_emails, _ips, _cards, _phones), strict=True))


def find_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind in a text as it stands."""
    return {kind: list(find(text)) for kind, find in _FINDERS.items()}


class Tape:
    """A rewritten text with the stretches that were replaced: (start, end) here, (start, end) in the text before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, at, here = [], 0, 0
        self.starts: list[int] = []
        self.stretches: list[tuple[int, int, int, int]] = []
        for start, end, new in edits:
            parts += [text[at:start], new]
            here += start - at
            self.starts.append(here)
            self.stretches.append((here, here + len(new), start, end))
            here += len(new)
            at = end
        self.text = "".join([*parts, text[at:]])

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The span in the text before, and whether a replaced stretch lies in it."""
        first, last = self._source(start, False), self._source(end - 1, True)
        i = bisect_right(self.starts, end - 1) - 1
        changed = i >= 0 and (self.stretches[i][1] > start or self.stretches[i][0] > start)
        return first, last, changed

    def _source(self, at: int, end: bool) -> int:
        i = bisect_right(self.starts, at) - 1
        if i < 0:
            return at + end
        here, here_end, start, stop = self.stretches[i]
        if at < here_end:
            return stop if end else start
        return stop + (at - here_end) + end


# Look-alike letters, by the Latin letter they stand for.
LOOK_ALIKES = {
    "a": "аα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "м",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝѡ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "-": "‐‑‒–—−", ".": "․。｡", "@": "﹫", "+": "﹢",
}
_INVISIBLE = "­​‌‍⁠﻿"


def _folding() -> dict[int, str]:
    """Look-alikes, digits of all scripts, and characters whose compatibility form is one visible ASCII character."""
    table = {ord(c): latin for latin, others in LOOK_ALIKES.items() for c in others}
    for i in range(0xA0, min(sys.maxunicode, 0x1FFFF) + 1):
        c = chr(i)
        form = unicodedata.normalize("NFKC", c)
        if i not in table and len(form) == 1 and " " <= form <= "~":
            table[i] = form
        elif i not in table and unicodedata.decimal(c, None) is not None:
            table[i] = str(unicodedata.decimal(c))
    return table | {ord(c): "" for c in _INVISIBLE}


_FOLD = _folding()
_FOLDED = frozenset(map(chr, _FOLD))


def fold_look_alikes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii() or not (found := _FOLDED.intersection(text)):
        return []
    return [(m.start(), m.end(), _FOLD[ord(m.group())]) for m in re.finditer("[" + re.escape("".join(found)) + "]", text)]


# Digits as words in the four languages of the texts.
DIGIT_WORDS = {
    "0": "zero oh null nul zéro cero", "1": "one eins un une uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete",
    "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_DIGIT = {word: digit for digit, words in DIGIT_WORDS.items() for word in words.split()}
_TIMES = {"double": 2, "triple": 3}
_WORD = "|".join(sorted(_DIGIT, key=len, reverse=True))
_ITEM = rf"(?:(?:double|triple)[\s-]{{1,3}})?(?:{_WORD})"
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[\s-]{{1,3}})?{_ITEM}(?:[\s,-]{{1,3}}{_ITEM})*(?![^\W_])", re.IGNORECASE)
_SPELLED_PLUS = re.compile(r"(?<![^\W_])plus[\s-]{1,3}(?=\(?[0-9])", re.IGNORECASE)
_LETTER_DIGITS = re.compile(r"(?<=[0-9])[OoIl|]+(?=[0-9])")


# Word separators as blanks and A-Z in lower case, for a cheap look at which words a text has.
_PLAIN = bytes(32 if i < 128 and not chr(i).isalnum() else i + 32 if 65 <= i <= 90 else i for i in range(256))
_DIGIT_BYTES = frozenset(w.encode() for w in _DIGIT)
_HAS_DIGIT = re.compile("[0-9]")


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


def _spelled(found: str) -> str:
    out, times = "", 1
    for word in re.split(r"[\s,-]+", found.lower()):
        if word == "plus":
            out += "+"
        elif word in _TIMES:
            times = _TIMES[word]
        else:
            out, times = out + _DIGIT[word] * times, 1
    return out


def read_digits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits: a run of words becomes a run of digits; also letters that stand between digits for 0 and 1."""
    edits, words = [], _words(text)
    if any(map(_DIGIT_BYTES.__contains__, words)):
        for m in _SPELLED.finditer(text):
            near = text[max(0, m.start() - 6) : m.start()] + " " + text[m.end() : m.end() + 6]
            if re.search(r"[\s,-]", m.group()) or re.search(r"[0-9.()\[\]]|dot|punkt|punto|point", near.lower()):
                edits.append((m.start(), m.end(), _spelled(m.group())))
    if b"plus" in words:
        edits += [(m.start(), m.end(), "+") for m in _SPELLED_PLUS.finditer(text)]
    if _HAS_DIGIT.search(text):
        edits += [(m.start(), m.end(), "".join("0" if c in "Oo" else "1" for c in m.group())) for m in _LETTER_DIGITS.finditer(text)]
    return sorted(edits)


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# Fixed values: "at" in the other languages of the texts, and endings of domains that a bare English "at" may lead to.
_FOREIGN_AT = "arobase|arroba|klammeraffe"
_ENDINGS = frozenset("com org net edu gov mil int info biz name dev app test example invalid".split())
# Words that show ordinary text where a name or a part of a domain would stand, if the ending is not a known one.
_PROSE = frozenset(
    """a an the this that these those my your his her its our their some any each every no all both one which what whose another
    i you he she it we they me him us them who there here then now when where how and or but if so as of to in on at by for from with
    is are was were be been being am has have had do does did not very just only too also again still
    look looks looked looking stare stared staring point points pointed pointing aim aimed laugh laughed smile smiled arrive arrived
    stop stopped start started meet met stay stayed live lives lived work works worked sit sat stand stood""".split()
)

# More words that stand before "at" and the address of a page, or name a part of one.
_POINTERS = _PROSE | frozenset(
    """available found find hosted located listed posted published based sold held seen shown offered registered stored kept
    details online more info information visit read see buy order shop page pages site sites website home news article articles
    download downloads mail email e-mail write contact reach ask us-based apply join help support questions comments feedback
    arrives arriving aimed happening happens while until after before during""".split()
)


def _like_address(local: str, labels: list[str], behind: str) -> bool:
    """A plain name, "at" and a domain with plain dots: is it an address and not a pointer to a page? No word of ordinary text on
    either side, no host of a web page, no path or port behind."""
    words = [x.lower() for x in (local, *labels)]
    return _POINTERS.isdisjoint(words) and words[1] != "www" and len(labels) <= 3 and behind not in ("/", ":", "?") and local[-1].isalnum()


_STRONG_AT = rf"[ \t]*{_OPEN}[ \t]*(?:at|@|{_FOREIGN_AT})[ \t]*{_CLOSE}[ \t]*|[ \t]+(?:{_FOREIGN_AT})[ \t]+|[ \t]+@[ \t]*|@[ \t]+|&#64;|&commat;|[ \t]*[_-]at[_-][ \t]*"
_AT = re.compile(rf"(?P<strong>{_STRONG_AT})|(?P<weak>[ \t]+at(?:[ \t]*\r?\n[ \t]*|[ \t]+))|(?P<plain>@)", re.IGNORECASE)
_SPELLED_DOT = rf"[ \t]*{_OPEN}[ \t]*(?:dot|point|punkt|punto|\.)[ \t]*{_CLOSE}[ \t]*|[ \t]+dot[ \t]+|[ \t]+\.[ \t]+|&#46;|[_-]dot[_-]"
_DOT = re.compile(_SPELLED_DOT, re.IGNORECASE)
_ANY_DOT = re.compile(_SPELLED_DOT + r"|[ \t]+(?:point|punkt|punto)[ \t]+", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_LAST_LABEL = re.compile(r"[A-Za-z]{2,}$")
_DIGIT_DOT = re.compile(rf"(?<=[0-9])(?:{_SPELLED_DOT}|[ \t]+(?:punkt|punto|point)[ \t]+)(?=[0-9])", re.IGNORECASE)
# What a disguised address shows at least: a sign, a bracketed "at", or a bare one before a domain with a plain dot.
_HINT = re.compile(r"[\[({<_-][ \t]*at[ \t]*[\])}>_-]|[ \t]at[ \t\r\n]+[a-z0-9-]+\.[a-z0-9]", re.IGNORECASE)
_FOREIGN = frozenset(w.encode() for w in _FOREIGN_AT.split("|"))
_DOT_BEFORE = re.compile(rf"(?:{_SPELLED_DOT})$", re.IGNORECASE)
_ANY_DOT_BEFORE = re.compile(rf"(?:{_ANY_DOT.pattern})$", re.IGNORECASE)


def read_addresses(text: str) -> list[tuple[int, int, str]]:
    """Written "at" and "dot": an address needs a name, a domain of two or more labels, and letters in the last one. A bare
    word "at" counts only with a written dot, or with a known ending where neither name nor domain look like ordinary text. A line may
    end behind it. A written dot takes
    any ending, unless a plain name and an unknown ending stand among words of ordinary text."""
    edits: list[tuple[int, int, str]] = []
    done = 0
    words = set(_words(text))
    hinted = "@" in text or "&#64;" in text or "&commat;" in text or b"dot" in words or words & _FOREIGN or _HINT.search(text)
    for m in _AT.finditer(text) if hinted else ():
        if m.start() < done:
            continue
        at, labels, dots = m.end(), [], []
        sure = m.lastgroup == "strong"
        while label := _LABEL.match(text, at):
            labels.append(label.group())
            at = label.end()
            dot = (_ANY_DOT if sure else _DOT).match(text, at)
            if dot and _LABEL.match(text, dot.end()):
                dots.append((dot.start(), dot.end(), "."))
                at = dot.end()
            elif text[at : at + 1] == "." and _LABEL.match(text, at + 1):
                at += 1
            else:
                break
        if len(labels) < 2 or not _LAST_LABEL.search(labels[-1]):
            continue
        start, before = m.start(), []
        while True:
            name = start
            while name > done and text[name - 1] in _LOCAL:
                name -= 1
            if name == start:
                if before:  # a written dot without a name before it
                    start = before.pop()[1]
                break
            start = name
            dot = (_ANY_DOT_BEFORE if sure else _DOT_BEFORE).search(text, max(done, start - 16), start)
            if dot is None or dot.start() == done or text[dot.start() - 1] not in _LOCAL:
                break
            before.append((dot.start(), dot.end(), "."))
            start = dot.start()
        if start == m.start():
            continue
        local = text[start : m.start()]
        if m.lastgroup == "weak":
            ending = labels[-1].lower()
            known = len(ending) == 2 or ending in _ENDINGS
            shaped = re.search(r"[0-9]|[A-Za-z][._%+-][A-Za-z]", local)
            if not dots and not (known and (shaped or _like_address(local, labels, text[at : at + 1]))):
                continue
            if dots and not (known or shaped) and not _PROSE.isdisjoint(x.lower() for x in (local, *labels)):
                continue
        if m.lastgroup == "plain" and not dots and not before:
            continue
        edits += [*reversed(before), (m.start(), m.end(), "@"), *dots]
        done = at
    taken = [(a, b) for a, b, _ in edits]
    for m in _DIGIT_DOT.finditer(text) if _HAS_DIGIT.search(text) else ():
        if not any(a < m.end() and m.start() < b for a, b in taken):
            edits.append((m.start(), m.end(), "."))
    return sorted(edits)


STAGES: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (fold_look_alikes, read_digits, read_addresses)


def disguised_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that show only after normalisation, in source characters."""
    tapes: list[Tape] = []
    current = text
    for stage in STAGES:
        if edits := stage(current):
            tapes.append(Tape(current, edits))
            current = tapes[-1].text
    added: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if not tapes:
        return added
    for kind, spans in find_spans(current).items():
        for start, end in spans:
            touched = False
            for tape in reversed(tapes):
                start, end, changed = tape.back(start, end)
                touched |= changed
            if touched and not any(a < end and start < b for a, b in base[kind]):
                added[kind].append((start, end))
    return added


def joined(spans: dict[str, list[Span]]) -> str:
    """``kind:start:end`` by start, then kind in the order of KINDS, joined by commas."""
    rows = sorted((start, k, end) for k, kind in enumerate(KINDS) for start, end in spans[kind])
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in rows)


_FOUND = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string,n_added:bigint>"


def _find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = []
        for item in batch:
            text = item.as_py() or ""
            base = find_spans(text)
            added = disguised_spans(text, base)
            every = {k: base[k] + added[k] for k in KINDS}
            sha = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((*(len(base[k]) for k in KINDS), sha, joined(every), sum(map(len, added.values()))))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
        yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, numbers of base spans by kind, SHA-256 of the base spans, all spans, and how many the transducers added."""
    return docs.select(F.col(id_col).alias("id"), F.arrow_udf(_find, _FOUND)(F.col(text_col)).alias("found")).select("id", "found.*")


def masked(text: str, spans: str, mask: str = "[{}]") -> str:
    """The text with every span of ``spans`` replaced by its kind; overlapping spans are masked together under the first kind."""
    out, at = [], 0
    for item in filter(None, spans.split(",")):
        kind, start, end = item.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], mask.format(kind.upper())]
        at = max(at, int(end))
    return "".join([*out, text[at:]])
