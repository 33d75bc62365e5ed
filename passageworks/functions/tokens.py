"""Token counters.

The default counts runs of word characters and single punctuation marks with a
regular expression in the JVM.  `batch_counter` wraps any Python counter (a BPE
encoder, say) in Arrow UDFs; such counts are usually not additive over
concatenation, so packing then counts joined texts instead of summing.  It does so piece
by piece, by the counter's running form.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

# Characters at the end of a text that are searched first for a place to cut.
_CUT_CHARS = 256

# Takes the next piece of a text and gives the count of the text up to its end.
Running = Callable[[str], int]
BatchCount = Callable[[Sequence[str]], Sequence[int]]


@dataclass(frozen=True)
class Cuts:
    """How the count of a text is made of counts of its parts.

    Where a match of `cut`, a regular expression, begins, a text can be divided without a
    change of the sum of the parts' `count`s, whatever stands before and behind it; `total`
    makes the text's count of that sum.
    """

    count: BatchCount
    cut: str
    total: Callable[[int], int] = int


@dataclass(frozen=True)
class TokenCounter:
    """`count` maps a string column, `count_each` an array<string> column.

    `additive` says that the count of texts joined by white-space-delimited
    separators is the sum of the single counts.  `running` begins a text that comes in
    pieces; a counter that is not additive needs it for packing.  With `cuts` a text that is
    joined many times is counted once: only what is before its first and behind its last
    cut meets other texts.
    """

    count: Callable[[Column], Column]
    count_each: Callable[[Column], Column]
    additive: bool = True
    running: Callable[[], Running] | None = None
    cuts: Cuts | None = None


def _regex_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


REGEX_COUNTER = TokenCounter(
    count=_regex_count,
    count_each=lambda texts: F.transform(texts, _regex_count),
    additive=True,
)


def recounted(fn: BatchCount) -> Running:
    """A running count for any counter: keeps the text and counts it anew with each piece."""
    text = ""

    def add(piece: str) -> int:
        nonlocal text
        text += piece
        return int(fn([text])[0])

    return add


def _last_cut(cuts: re.Pattern, text: str) -> int:
    """Where the last match begins, -1 if there is none."""
    at, start, window = -1, len(text), _CUT_CHARS
    while at < 0 and start > 0:  # looked for from the end: the text before is not searched
        start, window = max(0, len(text) - window), 8 * window
        for match in cuts.finditer(text, start):
            at = match.start()
    return at


def counted_by_cuts(fn: BatchCount, cut: str) -> Running:
    """A running count that keeps only what follows a late cut.

    `cut` is a regular expression; where a match begins, the text can be divided without
    a change of the sum of counts, whatever follows.  Each character before that
    cut is counted once.
    """
    cuts = re.compile(cut)
    done, tail = 0, ""

    def add(piece: str) -> int:
        nonlocal done, tail
        tail += piece
        at = max(0, _last_cut(cuts, tail))
        head, tail = tail[:at], tail[at:]
        counts = fn([head, tail])
        done += int(counts[0])
        return done + int(counts[1])

    return add


def parts_by_cuts(texts: Sequence[str | None], cuts: Cuts) -> list[tuple[str | None, int | None, str | None]]:
    """(head, inner, tail) of each text: what is before its first cut, the sum of the counts
    between that and the last, and what is from the last on.

    A text without a cut is all head, and its `inner` is None; so are all three of None.
    """
    pattern, out, inner = re.compile(cuts.cut), [], {}
    for i, text in enumerate(texts):
        last = -1 if text is None else _last_cut(pattern, text)
        if last < 0:
            out.append((text, None, None if text is None else ""))
            continue
        match = pattern.search(text, 0, last)
        first = last if match is None else match.start()
        out.append((text[:first], None, text[last:]))
        inner[i] = text[first:last]
    for i, n in zip(inner, cuts.count(list(inner.values()))):
        out[i] = (out[i][0], int(n), out[i][2])
    return out


class JoinedParts:
    """The count of a text that is joined from short texts and from `parts_by_cuts` of others."""

    def __init__(self, cuts: Cuts):
        self._cuts, self._pattern = cuts, re.compile(cuts.cut)
        self._done, self._tail = 0, ""

    def add(self, text: str) -> None:
        self._tail += text

    def add_parts(self, head: str, inner: int | None, tail: str) -> None:
        if inner is None:
            at = max(0, _last_cut(self._pattern, joined := self._tail + head))
            self._done += int(self._cuts.count([joined[:at]])[0])
            self._tail = joined[at:]
        else:
            self._done += int(self._cuts.count([self._tail + head])[0]) + inner
            self._tail = tail

    def count(self) -> int:
        return self._cuts.total(self._done + int(self._cuts.count([self._tail])[0]))


def batch_counter(
    fn: BatchCount,
    additive: bool = False,
    running: Callable[[], Running] | None = None,
    cuts: Cuts | None = None,
) -> TokenCounter:
    """A counter from a function over a batch of texts; NULL counts as empty.

    Without a `running` form (`counted_by_cuts`, say) a text in pieces is counted anew
    with each piece.  `cuts`, where counts of parts can be put together, spares moving and
    counting the texts for that.
    """

    def counts(texts: pa.Array) -> pa.Array:
        return pa.array(list(fn(texts.fill_null("").to_pylist())), pa.int32())

    @F.arrow_udf(T.IntegerType())
    def one(texts: pa.Array) -> pa.Array:
        return counts(texts)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def each(lists: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(
            _offsets(lists), counts(lists.flatten())
        )

    begin = running or (lambda: recounted(fn))
    return TokenCounter(count=one, count_each=each, additive=additive, running=begin, cuts=cuts)


def _offsets(lists: pa.Array) -> pa.Array:
    """List offsets from zero; a NULL list becomes an empty one."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array([0, *sizes.cumsum().tolist()], pa.int32())
