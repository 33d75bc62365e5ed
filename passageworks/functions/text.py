"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from passageworks.functions import fixed

# Unicode white space plus the four separators U+001C-U+001F.  Spelled out so
# that trimming, collapsing and splitting agree with each other.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
BLANK_LINE = rf"\n{WS_CLASS}*\n"


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(text, WS_CLASS + "+", " ")


def _without_blanks(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_paragraphs(text: Column) -> Column:
    """Array of paragraphs: split on blank lines, stripped, no blanks kept."""
    return _without_blanks(F.split(text, BLANK_LINE))


def split_sentences(paragraph: Column) -> Column:
    """Array of sentences: white space collapsed, split after `.`, `!` or `?`."""
    return F.filter(
        F.split(strip(collapse(paragraph)), r"(?<=[.!?]) "), lambda s: s != ""
    )


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    """Whether any of the words is a substring; false without words."""
    tests = [F.contains(lowered, F.lit(w)) for w in words]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def keyword_set(topics: Mapping[str, Sequence[str]]) -> list[str]:
    """Distinct keywords of a topic map, in first-seen order."""
    return list(dict.fromkeys(w for words in topics.values() for w in words))


def topic_label(
    text: Column,
    topics: Mapping[str, Sequence[str]] = fixed.TOPICS,
    default: str = fixed.DEFAULT_LABEL,
) -> Column:
    """`[topic]` of the first topic with a keyword inside the lower-cased text."""
    return label_of_lowered(F.lower(text), topics, default)


def label_of_lowered(
    lowered: Column, topics: Mapping[str, Sequence[str]], default: str
) -> Column:
    """`topic_label` on a column that is lower-cased already, once for all tests."""
    label = None
    for topic, words in topics.items():
        hit = contains_any(lowered, words)
        label = (
            F.when(hit, F.lit(f"[{topic}]"))
            if label is None
            else label.when(hit, F.lit(f"[{topic}]"))
        )
    return F.lit(default) if label is None else label.otherwise(F.lit(default))


def text_or_null_word(value: Column) -> Column:
    """Render a value for a template, NULL as the fixed word."""
    return F.coalesce(value.cast("string"), F.lit(fixed.NULL_TEXT))


def timestamp_text(ts: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss`, with six fraction digits when there is a fraction.

    The cast needs no time zone for `timestamp_ntz`, unlike `date_format`.
    """
    raw = ts.cast("string")
    return F.when(F.contains(raw, F.lit(".")), F.rpad(raw, 26, "0")).otherwise(raw)


def first_cut(text: Column, stops: Sequence[str]) -> Column:
    """The text before the earliest stop sequence."""
    if not stops:
        return text
    pattern = "|".join(rf"\Q{s}\E" for s in stops)
    return F.element_at(F.split(text, pattern, 2), 1)
