"""Spelling variants: words one edit apart, found by PartEnum signatures of letter multisets.

Words are runs of Latin letters, with A-Z lower-cased, that occur often enough.  A word's
letter multiset is a binary vector with one dimension for each letter and each number of
its occurrence.  One edit changes at most two of them, so near words have vectors of
Hamming distance at most two.  Dimensions are dealt into `PARTS` parts; two vectors that
differ in at most two dimensions agree on all but two parts, so on one at least of the
enumerated choices of `PARTS - 2` parts.  Each choice is a signature: its number, the length of
the longer word, and the dimensions that the word has there.

Anagrams have equal vectors and would fill a signature's group without being near.  A
signature is therefore split by a half of the word: one edit leaves either the first or
the last half of the longer word's length untouched, so each signature goes out once with
either half.  Words meet in an equi-join on the signature's hash, and the join's own
condition verifies the edit, so that only near pairs become rows.  No group is cut; a
group that is still large is an ordinary join key, which Spark splits where it is skewed.
The join asks for sorting: Spark takes the signatures to be as large as the words they are
made of, a small part of their size, and would broadcast them.

Counts are combined in the tasks before they are shuffled.  Chains of forms are followed by
doubling, one join for each power of two: a form occurs five times as often as its word, so
chains are short.

Defined cases: null texts have no words; a null id is written as the empty text; rows that
repeat an id or a whole row count again; without words there are no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.batches import slices
from passageworks.llm.columns import picked, whole
from passageworks.session import ship_package, stored

LETTERS, OFTEN, RATIO = 6, 5, 5
#: One run in so many loses a letter, by the hash of its document's id and itself.
SLIPS = 199
#: Parts of the dimensions, and how many may differ.
PARTS, DISTANCE = 4, 2
CHOICES = list(combinations(range(PARTS), PARTS - DISTANCE))
WORK_BYTES = 4 << 20
#: Characters of the distinct words that a task holds before it sends their counts on.
HELD_CHARS = 8 << 20
#: Words whose signatures are made at once.
SIGNED = 8_192


def _counted(letters: int, slips: int):
    run = re.compile(f"[a-zÀ-ÿ]{{{letters},}}")

    def emit(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = {}, 0
        for batch in slices(batches, "text", WORK_BYTES):
            texts = pc.ascii_lower(batch.column("text")).to_pylist()
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                start = crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(run.findall(text)).items():
                    h = crc32(word.encode(), start)
                    if h % slips == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < letters:
                            continue
                    if word in held:
                        held[word] += n
                    else:
                        held[word] = n
                        chars += len(word)
                if chars > HELD_CHARS:
                    yield emit(held)
                    held, chars = {}, 0
        yield emit(held)

    return count


def words(
    docs: DataFrame, *, letters: int = LETTERS, often: int = OFTEN, slips: int = SLIPS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(word, n): words of at least `letters` letters with at least `often` occurrences."""
    ship_package(docs.sparkSession)
    own = picked(docs, doc_id=id_col, text=text_col)
    texts = own.select("doc_id", whole(F.col("text")).alias("text"))
    counts = texts.mapInArrow(_counted(letters, slips), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def parts(word: str) -> list[bytes]:
    """The dimensions that the word's vector has in each part."""
    out: list[list[str]] = [[] for _ in range(PARTS)]
    seen: Counter = Counter()
    for letter in sorted(word):
        seen[letter] += 1
        # Spreads both the letters and their repeats over the parts.
        out[(ord(letter) * 7 + seen[letter] * 3 + (ord(letter) >> 2)) % PARTS].append(letter)
    return ["".join(p).encode() for p in out]


def signatures(word: str) -> tuple[list[int], list[int]]:
    """Keys of the word as the longer one or one of equal length, and as the shorter one."""
    held = parts(word)
    projected = [b"\xff".join(held[p] for p in choice) for choice in CHOICES]

    def keys(longer: int) -> list[int]:
        half = longer // 2
        sides = (b"<" + word[:half].encode(), b">" + word[half - longer :].encode())
        return [
            xxhash.xxh3_64_intdigest(b"%d,%d,%s\xff%s" % (longer, i, dimensions, side)) - (1 << 63)
            for i, dimensions in enumerate(projected)
            for side in sides
        ]

    return keys(len(word)), keys(len(word) + 1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SIGNED):
            part = batch.slice(at, SIGNED)
            keys, own, rows = [], [], []
            for i, word in enumerate(part.column("word").to_pylist()):
                longer, shorter = signatures(word)
                keys += longer + shorter
                own += [True] * len(longer) + [False] * len(shorter)
                rows += [i] * (len(longer) + len(shorter))
            taken = part.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(own, pa.bool_()), taken.column("word"), taken.column("n")],
                ["key", "own", "word", "n"],
            )


def near_words(counted: DataFrame) -> DataFrame:
    """(word, other, n, other_n), both ways, of (word, n): pairs one insertion, deletion or
    replacement of a letter apart; one row for each."""
    signed = counted.mapInArrow(_signed, "key long, own boolean, word string, n long")
    a = signed.where("own").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = signed.select("key", "own", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # Of two words of equal length both ways meet; one is enough.
    once = ~F.col("own") | (F.col("a") < F.col("b"))
    near = a.join(b.hint("merge"), "key").where(once & (F.levenshtein("a", "b", 1) == 1))
    ways = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("a_n").alias("n"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("b_n").alias("n"), F.col("a_n").alias("other_n")),
    )
    # Pairs that share several signatures meet several times.
    return near.select(F.explode(ways).alias("w")).select("w.*").repartition("word").dropDuplicates(["word", "other"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms that follow each other."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(reached.join(onward, "root", "left").select("word", "root", "next"), "spelling-roots")
        if longer.where("next IS NOT NULL").isEmpty():
            return reached
        reached = longer.select("word", F.coalesce("next", "root").alias("root"))


def variants(
    docs: DataFrame, *, letters: int = LETTERS, often: int = OFTEN, slips: int = SLIPS, ratio: int = RATIO,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    `form` is the near word with most occurrences, the first in code-point order among
    equals, if it has `ratio` times those of the word.
    """
    counted = words(docs, letters=letters, often=often, slips=slips, id_col=id_col, text_col=text_col)
    counted = stored(counted, "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    # A word's neighbours are few, as its letters and the alphabet bound them.
    linked = near_words(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = stored(
        counted.join(linked, "word", "left").select("word", "n", "n_near", "best.form", (-F.col("best.less")).alias("form_n")),
        "spelling-near",
    )
    taken = F.col("form_n") >= F.lit(ratio) * F.col("n")
    last = roots(joined.where(taken))
    return joined.join(last, "word", "left").select(
        "word",
        F.when(taken, F.col("form")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("form_n")).alias("form_n"),
    )
