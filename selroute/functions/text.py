"""Text clean-up and tokenising as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 ASCII punctuation marks and the three English articles.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")

# Every character that counts as white space when a text is split.
WHITE_SPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The published mteval-v13a tokeniser, as pattern and replacement in the order of use.
MTEVAL_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
MTEVAL_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))

# Fixed value: a boxed answer whose content may hold one nested level of braces.
BOXED = r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"

REFERENCE_SEPARATOR = "\n---\n"


def _blanks(text: Column, drop: str = "") -> Column:
    """Every white-space character as a blank, and the characters of ``drop`` left out, in one pass over the text."""
    return F.translate(text, WHITE_SPACE + drop, " " * len(WHITE_SPACE))


def words(line: Column) -> Column:
    """Split at blanks, without empty pieces."""
    return F.filter(F.split(line, " "), lambda w: w != "")


def answer_line(text: Column) -> Column:
    """Lower case, drop ASCII punctuation, drop the articles; what is left stands between blanks (one or more).

    An article is dropped where it stands between characters that are neither letters nor digits, so it
    also goes next to non-ASCII marks such as a dash or a curly quote, and never from inside a word.
    """
    bare = _blanks(F.lower(text), ASCII_PUNCTUATION)
    article = r"(?<![\p{L}\p{N}_])(?:" + "|".join(ARTICLES) + r")(?![\p{L}\p{N}_])"
    return F.regexp_replace(bare, article, " ")


def answer_tokens(text: Column) -> Column:
    return words(answer_line(text))


def normalise_answer(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def mteval_line(text: Column) -> Column:
    """The text by the mteval-v13a rules, its tokens between blanks (one or more); case is kept."""
    line = F.replace(text, F.lit("<skipped>"), F.lit(""))
    line = F.replace(line, F.lit("-\n"), F.lit(""))
    line = F.replace(line, F.lit("\n"), F.lit(" "))
    for entity, mark in MTEVAL_ENTITIES:
        line = F.replace(line, F.lit(entity), F.lit(mark))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for pattern, replacement in MTEVAL_13A:
        line = F.regexp_replace(line, pattern, replacement)
    return _blanks(line)


def mteval_tokens(text: Column) -> Column:
    return words(mteval_line(text))


def boxed_answer(text: Column) -> Column:
    """Content of the first boxed answer; NULL when there is none (an empty box gives '')."""
    return F.when(F.regexp_like(text, F.lit(BOXED)), F.regexp_extract(text, BOXED, 1))


def reference_texts(references: Column) -> Column:
    """All reference texts in one string; empty when there are no references."""
    texts = F.transform(references, lambda r: r["output"]["text"])
    return F.coalesce(F.array_join(texts, REFERENCE_SEPARATOR), F.lit(""))


def first_reference(references: Column) -> Column:
    return F.get(references, 0)["output"]["text"]


def correct_option(references: Column) -> Column:
    """Letter (A for the first) of the last reference tagged exactly 'correct'; '' when none is."""
    flags = F.transform(references, lambda r, i: F.when(r["tags"] == F.array(F.lit("correct")), i).otherwise(-1))
    last = F.array_max(flags)
    return F.when(last >= 0, F.chr(last + ord("A"))).otherwise(F.lit(""))
