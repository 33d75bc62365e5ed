"""Topic labels for large keyword maps: one automaton, one pass over each text.

A chain of substring tests costs one pass over a text for each keyword.  Here all keywords
form one trie with failure links, laid out as a table of states by letter classes, and each
text is read once.  A state knows the first topic that has a keyword ending there, so
the least number seen on the way is the label, as in the chain.  The texts of an Arrow batch
advance together, letter by letter, as one array of states.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from passageworks.functions import fixed

# A table has at most this many cells of four bytes; larger maps get several tables.
MAX_CELLS = 1 << 25
_TEXT_BYTES = 4 << 20


@dataclass(frozen=True)
class Automaton:
    """`letters` are the sorted code points of all keywords, class 0 being any other;
    `move[state, class]` is the next state; `label[state]` the first topic, or `none`."""

    letters: np.ndarray
    move: np.ndarray
    label: np.ndarray
    none: int

    def first_labels(self, texts: pa.Array) -> np.ndarray:
        """The least topic number of any keyword inside each text, `none` without one."""
        data = [("" if t is None else t).encode("utf-32-le", "surrogatepass") for t in texts.to_pylist()]
        sizes = np.array([len(d) // 4 for d in data], np.int64)
        points = np.frombuffer(b"".join(data), np.uint32)
        place = np.minimum(np.searchsorted(self.letters, points), max(len(self.letters) - 1, 0))
        known = self.letters[place] == points if len(self.letters) else np.zeros(len(points), bool)
        classes = np.where(known, place + 1, 0)
        # Long texts first: those still running are a prefix.
        order = np.argsort(-sizes, kind="stable")
        starts, ordered = (np.cumsum(sizes) - sizes)[order], sizes[order]
        state = np.zeros(len(order), np.int32)
        best = np.full(len(order), self.label[0], np.int32)
        running = np.searchsorted(-ordered, -np.arange(1, (ordered[0] if len(ordered) else 0) + 1), "right")
        for i, n in enumerate(running.tolist()):
            state[:n] = self.move[state[:n], classes[starts[:n] + i]]
            np.minimum(best[:n], self.label[state[:n]], out=best[:n])
        out = np.empty(len(order), np.int32)
        out[order] = best
        return out


def build(topics: Sequence[tuple[int, str]], none: int) -> Automaton:
    """The automaton of (topic number, keyword) pairs; an empty keyword is in every text."""
    letters = np.unique(np.array([ord(c) for _, w in topics for c in w], np.uint32))
    number = {int(p): i + 1 for i, p in enumerate(letters)}
    width = len(letters) + 1
    children: list[dict[int, int]] = [{}]
    label = [none]
    for topic, word in topics:
        state = 0
        for c in map(ord, word):
            if number[c] not in children[state]:
                children[state][number[c]] = len(children)
                children.append({})
                label.append(none)
            state = children[state][number[c]]
        label[state] = min(label[state], topic)
    move = np.zeros((len(children), width), np.int32)
    labels = np.array(label, np.int32)
    waiting = deque()
    for c, child in children[0].items():
        move[0, c] = child
        waiting.append((child, 0))
    while waiting:
        state, fallback = waiting.popleft()
        labels[state] = min(labels[state], labels[fallback])
        move[state] = move[fallback]
        for c, child in children[state].items():
            waiting.append((child, move[fallback, c]))
            move[state, c] = child
    labels = np.minimum(labels, labels[0])
    return Automaton(letters, move, labels, none)


def automata(topics: Sequence[tuple[int, str]], none: int, most: int = MAX_CELLS) -> list[Automaton]:
    """As many automata as keep each table within `most` cells, keywords in order."""
    letters = len({c for _, w in topics for c in w}) + 1
    parts: list[list[tuple[int, str]]] = [[]]
    size = 1
    for topic, word in sorted(topics, key=lambda t: t[1]):
        if parts[-1] and (size + len(word)) * letters > most:
            parts.append([])
            size = 1
        parts[-1].append((topic, word))
        size += len(word)
    return [build(p, none) for p in parts]


def topic_label_wide(
    spark: SparkSession,
    text: Column,
    topics: Mapping[str, Sequence[str]],
    default: str = fixed.DEFAULT_LABEL,
    most: int = MAX_CELLS,
) -> Column:
    """As `functions.text.topic_label`, for maps of any number of keywords.

    The tables, of a size checked above, are broadcast; texts go to Python once, lower-cased.
    A null text has no label, as in the chain.
    """
    names = list(topics)
    pairs = [(i, w) for i, name in enumerate(names) for w in topics[name]]
    shared = spark.sparkContext.broadcast(automata(pairs, len(names), most))

    @F.arrow_udf("int")
    def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.full(len(texts), len(names), np.int32)
            step = max(1, len(texts) * _TEXT_BYTES // max(1, texts.nbytes))
            for table in shared.value:
                for at in range(0, len(texts), step):
                    part = slice(at, at + step)
                    found[part] = np.minimum(found[part], table.first_labels(texts[part]))
            yield pa.array(found)

    labels = F.array(*(F.lit(f"[{n}]") for n in names), F.lit(default))
    return F.get(labels, numbers(F.coalesce(F.lower(text), F.lit(""))))
