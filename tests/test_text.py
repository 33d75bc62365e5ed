"""Text rules on cases the test tables do not contain."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passageworks.functions import fixed, text
from passageworks.functions.tokens import REGEX_COUNTER, batch_counter
from passageworks.operators import chunking


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values()) or (0,)], list(inputs) or ["_"])
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("one\n \t\ntwo", ["one", "two"]),
        ("\n\n  one \n\n\n\n two\n\n", ["one", "two"]),
        (" \n\t\n ", []),
        ("", []),
        ("one\ntwo", ["one\ntwo"]),
        ("one\n\u00a0\u2003\ntwo", ["one", "two"]),
        ("one\n\x1c\ntwo\x1f", ["one", "two"]),
    ],
)
def test_paragraphs(spark, raw, expected):
    assert value(spark, text.split_paragraphs(F.col("t")), t=raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("a.. b", ["a..", "b"]),
        ("x?! y", ["x?!", "y"]),
        ("no end", ["no end"]),
        ("a\nb. c", ["a b.", "c"]),
        ("  a.   b!  ", ["a.", "b!"]),
        ("3.14 is. . it", ["3.14 is.", ".", "it"]),
    ],
)
def test_sentences(spark, raw, expected):
    assert value(spark, text.split_sentences(F.col("t")), t=raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Elfelejtettem a JELSZÓ mezőt", "[Jegy – Belépési problémák]"),
        ("számla és jelszó", "[Jegy – Belépési problémák]"),
        ("megszámlálhatatlan számlatételek", "[Jegy – Számlázás]"),
        ("customeragent", "[Ügyfél]"),
        ("semmi különös", fixed.DEFAULT_LABEL),
    ],
)
def test_topic_label(spark, raw, expected):
    assert value(spark, text.topic_label(F.col("t")), t=raw) == expected


def test_topic_label_without_topics(spark):
    assert value(spark, text.topic_label(F.col("t"), {}, "[x]"), t="a") == "[x]"


def test_keyword_set_is_distinct():
    assert text.keyword_set({"a": ["x", "y"], "b": ["y", "z"]}) == ["x", "y", "z"]


def test_timestamp_text(spark):
    rows = spark.sql(
        "SELECT timestamp_ntz'2024-02-01 08:30:00' t UNION ALL "
        "SELECT timestamp_ntz'2024-02-01 08:30:00.5' UNION ALL SELECT NULL"
    )
    shown = text.text_or_null_word(text.timestamp_text(F.col("t")))
    assert {r.v for r in rows.select(shown.alias("v")).collect()} == {
        "2024-02-01 08:30:00",
        "2024-02-01 08:30:00.500000",
        "None",
    }


def test_first_cut_takes_the_earliest_stop(spark):
    assert value(spark, text.first_cut(F.col("t"), ["yy", "x.x"]), t="ab x.x c yy") == "ab "
    assert value(spark, text.first_cut(F.col("t"), ["zz"]), t="ab") == "ab"


def test_token_counters(spark):
    words = batch_counter(lambda texts: [len(t.split()) for t in texts], additive=True)
    assert value(spark, REGEX_COUNTER.count(F.col("t")), t="Ez, egy_2 próba!") == 5
    assert value(spark, words.count(F.col("t")), t="a b  c") == 3
    assert value(spark, words.count_each(F.col("t")), t=["a b", "", "c"]) == [2, 0, 1]


@given(st.lists(st.integers(0, 30), max_size=80), st.integers(1, 120))
@settings(max_examples=300, deadline=None)
def test_sentence_windows_have_the_properties_of_the_rule(counts, max_tokens):
    overlap = chunking.overlap_sentences(max_tokens)
    starts, sizes = chunking.sentence_windows(counts, max_tokens, overlap)
    ranges = [(s - 1, s - 1 + n) for s, n in zip(starts, sizes)]
    assert_windows(ranges, counts, max_tokens, overlap)


def assert_windows(ranges, counts, max_tokens, overlap):
    """What ranges of sentences must fulfil, each stated on its own."""
    long = [n > max_tokens for n in counts]
    # Every sentence is covered, ranges go forward and leave no gap.
    assert {i for a, b in ranges for i in range(a, b)} == set(range(len(counts)))
    assert all(a < b for a, b in ranges)
    assert all(x[1] < y[1] and y[0] <= x[1] for x, y in zip(ranges, ranges[1:]))
    for k, (a, b) in enumerate(ranges):
        # A sentence over the limit stands alone, and none is repeated across it.
        assert not any(long[a:b]) or b - a == 1
        before = ranges[k - 1] if k else (0, 0)
        if long[a] or (k and long[before[0]]):
            assert a == before[1]
            continue
        # Otherwise the last `overlap` sentences of the range before are repeated.
        assert a == max(before[0], before[1] - overlap)
        # What a range adds after its first new sentence fits; one more would not.
        if b - before[1] > 1:
            assert sum(counts[a:b]) <= max_tokens
        if b < len(counts) and not long[b]:
            assert sum(counts[a : b + 1]) > max_tokens


def test_window_cases():
    # Fits exactly; overflow repeats everything when there are few sentences.
    assert chunking.sentence_windows([5, 5], 10, 10) == ([1], [2])
    assert chunking.sentence_windows([5, 5, 1], 10, 10) == ([1, 1], [2, 3])
    # Only the last `overlap` repeat when there are many.
    assert chunking.sentence_windows([1] * 13, 12, 10) == ([1, 3], [12, 11])
    # A long sentence stands alone and clears the repetition.
    assert chunking.sentence_windows([2, 99, 3], 10, 10) == ([1, 2, 3], [1, 1, 1])


def chunks(spark, body, **options):
    docs = spark.createDataFrame([(1, body)], "doc_id long, text string")
    rows = chunking.hybrid_chunks(docs, **options).orderBy("para_no", "piece_no").collect()
    return [r.content for r in rows]


def test_special_paragraph_stays_whole(spark):
    body = "A számla hibás. " * 200
    assert chunks(spark, body, max_tokens=20) == ["[Jegy – Számlázás] " + body.strip()]


def test_short_paragraph_keeps_its_line_breaks(spark):
    assert chunks(spark, "egy\nkettő\n\nhárom") == [
        "[Általános] egy\nkettő",
        "[Általános] három",
    ]


def test_long_paragraph_crosses_slabs(spark):
    """More chunks than one slab holds: two sentences fit, all of them are repeated."""
    sentences = [f"w{i} a b c." for i in range(3 * chunking.SLAB)]
    got = chunks(spark, "\n".join(sentences), max_tokens=12)
    assert len(got) > 2 * chunking.SLAB
    ranges = []
    for body in got:
        words = body.removeprefix("[Általános] ").split()
        first, n = int(words[0][1:]), len(words) // 4
        assert " ".join(sentences[first : first + n]) == " ".join(words)
        ranges.append((first, first + n))
    assert_windows(ranges, [5] * len(sentences), 12, chunking.overlap_sentences(12))


def test_keyword_with_a_space_can_appear_by_collapsing(spark):
    body = "foo\nbar a b c. x y z u v w."
    assert chunks(spark, body, max_tokens=7, topics={"T": ["foo bar"]})[0].startswith("[T] ")


def test_custom_counter_drives_the_limit(spark):
    words = batch_counter(lambda texts: [len(t.split()) for t in texts])
    got = chunks(spark, "a b. c d. e f.", max_tokens=4, counter=words)
    assert got == ["[Általános] a b. c d.", "[Általános] a b. c d. e f."]
