"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a piece of text lie in a linked list.  A heap holds the adjacent pairs that
the vocabulary merges, by rank and then by place; the lowest is popped, its two symbols
become one, and the pairs with the new neighbours are pushed.  Entries whose symbols have
changed meanwhile are passed over.  A piece has as many tokens as it had symbols, less the
merges; no identifiers are made.

How a text becomes pieces is the tokenizer's own setup: special strings first, then
its normalizer and pre-tokenizer.  Where that setup drops white space, words between spaces
and line feeds are independent, so each distinct word is counted once and remembered.
Nothing is shuffled; documents are counted where they are read.

Defined cases: null and empty texts have no token; a text without white space is one word,
and its memory follows its longest piece; rows that repeat an id or a whole row are counted
each.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.batches import slices
from passageworks.llm.columns import picked, whole
from passageworks.session import ship_package

LIMIT = 2048
#: Text bytes that a task works on at once, and characters of the words a worker remembers.
WORK_BYTES, MEMORY_CHARS = 4 << 20, 8 << 20
#: Longer words are counted again each time.
REMEMBERED = 64


class Merger:
    """Counts what is left of a piece's symbols after all merges."""

    def __init__(self, merges: list[list[str]], suffix: str, known: set[str]):
        self.suffix, self.known = suffix, known
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}

    def symbols(self, piece: str) -> list[str]:
        """One for each letter, the last with the suffix; unknown ones go."""
        found = [*piece[:-1], piece[-1] + self.suffix]
        return found if self.known.issuperset(found) else [s for s in found if s in self.known]

    def count(self, piece: str) -> int:
        symbols = self.symbols(piece)
        left = len(symbols)
        ranks = self.ranks
        # Rank and place in one number: the rank decides, then the place.
        heap = [
            (rank << 32) | i
            for i, pair in enumerate(zip(symbols, symbols[1:]))
            if (rank := ranks.get(pair)) is not None
        ]
        if not heap:
            return left
        heapify(heap)
        end = left
        after, before = array("q", range(1, end + 1)), array("q", range(-1, end - 1))
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            a = symbols[i]
            if not a or j >= end or ranks.get((a, symbols[j])) != entry >> 32:
                continue
            merged = symbols[i] = a + symbols[j]
            symbols[j] = ""
            left -= 1
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                rank = ranks.get((merged, symbols[k]))
                if rank is not None:
                    heappush(heap, (rank << 32) | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get((symbols[h], merged))
                if rank is not None:
                    heappush(heap, (rank << 32) | h)
        return left


class Counter:
    """Token counts of texts, for a byte-pair tokenizer file of the tokenizers library."""

    #: Latin letters with ASCII marks behind them; an apostrophe starts pieces of its own.
    PLAIN = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        model = setup["model"]
        if model["type"] != "BPE" or any(
            model.get(x) for x in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix")
        ):
            raise ValueError("token counts need a plain byte-pair model")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merger = Merger(merges, model["end_of_word_suffix"] or "", set(model["vocab"]))
        added = setup["added_tokens"]
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError("special strings must be taken as they stand")
        strings = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings)) or r"(?!)")
        steps = [x.get("type") for k in ("normalizer", "pre_tokenizer") for x in _steps(setup[k])]
        #: White space is dropped, letters stand apart from marks, and bytes become letters.
        self.worded = steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
        self.letters = _byte_letters()
        self.words: dict[str, int] = {"": 0}
        self.pieces: dict[str, int] = {"": 0}
        self.held = 0

    def _piece(self, piece: str) -> int:
        found = self.pieces.get(piece)
        if found is None:
            found = self.merger.count(piece)
            if len(piece) <= REMEMBERED:
                self.pieces[piece] = found
                self.held += len(piece)
        return found

    def _any(self, text: str) -> int:
        """Of any text, by the tokenizer's own steps."""
        if not text:
            return 0
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += 1 + self._any(text[at : m.start()])
            at = m.end()
        if at:
            return total + self._any(text[at:])
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.tokenizer.pre_tokenizer is None:
            return self._piece(text)
        return sum(self._piece(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def _word(self, word: str) -> int:
        m = self.PLAIN.fullmatch(word)
        if m is None or not m[1].isalpha() or max(word) >= "ɐ":
            return self._any(word)
        letters = m[1].lower()
        if not word.isascii():
            if len(letters) != len(m[1]) or not unicodedata.is_normalized("NFC", word):
                return self._any(word)
            letters = "".join(map(self.letters.__getitem__, letters.encode()))
        return self._piece(letters) + self._piece(m[2])

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        if not self.worded:
            return np.array([self._any(t) for t in texts.to_pylist()], np.int64)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.dictionary_encode(words.flatten())
        distinct = coded.dictionary.to_pylist()
        if self.held > MEMORY_CHARS:
            self.words, self.pieces, self.held = {"": 0}, {"": 0}, 0
        counts = np.empty(len(distinct), np.int64)
        for i, word in enumerate(distinct):
            found = self.words.get(word)
            if found is None:
                found = self._word(word)
                if len(word) <= REMEMBERED:
                    self.words[word] = found
                    self.held += len(word)
            counts[i] = found
        sums = np.concatenate([[0], np.cumsum(counts[coded.indices.to_numpy()])])
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        ends = np.cumsum(per_text)
        return sums[ends] - sums[ends - per_text]


def _steps(setup: dict | None) -> list[dict]:
    if setup is None:
        return []
    return setup.get("normalizers") or setup.get("pretokenizers") or [setup]


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: itself where it is printable."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_counters: dict[str, Counter] = {}


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path)
        counter = _counters[path]
        for part in slices(batches, "text", WORK_BYTES):
            texts = part.column("text")
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(counter.count(texts))],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(
    docs: DataFrame, tokenizer: str, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit.

    `tokenizer` is a tokenizers file that executors can open.
    """
    ship_package(docs.sparkSession)
    own = picked(docs, doc_id=id_col, text=text_col)
    texts = own.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    counted = texts.mapInArrow(_counted(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
