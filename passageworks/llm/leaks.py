"""Benchmark passages in documents, by greedy string tiling.

Items and documents are lower-cased words.  Windows of `SEED` words have Karp-Rabin
hashes; a document's windows that may be an item's are joined to them.  A pair of
document and item that shares enough seeds is tiled: matches are runs of seeds
along a diagonal, the longest is marked, what it overlaps is cut back, and so on until
no match of `SEED` words is left.  Words in tiles over words of the item is the
coverage, whatever the order of the tiles, so reordered passages count.

Tasks drop windows by a bit table of the items' hashes, of `BITS` bits at any number of
items; the join after it is exact, so false positives only cost their rows.  A tile of
L words holds L - SEED + 1 seeds, so coverage c of an item of n words needs at least
c n / SEED of its seeds in the document; pairs with fewer are not tiled.

Defined cases: null and empty texts have no words; items under `SEED` words are one
seed of all their words; null item ids are an item like any other; rows that repeat an
id are documents, or items, of their own, and give a row each; a document with two
copies of a passage is covered once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.batches import mixed, ragged, slices
from passageworks.llm.columns import fresh, picked, whole
from passageworks.session import ship_package, stored

SEED = 5
COVERAGE = 0.5
BITS = 1 << 26
WORK_BYTES = 1 << 20
WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)


class Hashes:
    """Word -> 64-bit hash; to hash again is quicker than to remember, and holds nothing."""

    __getitem__ = staticmethod(xxhash.xxh3_64_intdigest)


def word_hashes(texts: list[str], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    look, rows = known.__getitem__, []
    for text in texts:
        found = WORD.findall(text.lower())
        rows.append(np.fromiter(map(look, found), np.uint64, len(found)))
    return np.concatenate([*rows, np.zeros(0, np.uint64)]), np.array([len(r) for r in rows], np.int64)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` words, mixed."""
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        total *= BASE
        total += words[k : k + len(total)]
    return mixed(total + np.uint64(size))


def windows(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of the windows inside each text."""
    inside = np.maximum(counts - size + 1, 0)
    at = ragged(np.cumsum(counts) - counts, inside)
    owner = np.repeat(np.arange(len(counts)), inside)
    return rolling(words, size)[at], owner, at - (np.cumsum(counts) - counts)[owner]


def item_seeds(items: DataFrame) -> DataFrame:
    """Per item and seed: item (its number), item_id, n_words, hash, place, size; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in slices(batches, "text", WORK_BYTES):
            words, counts = word_hashes(batch.column("text").to_pylist(), known)
            parts = [windows(words, counts, SEED)]
            sizes = [SEED]
            for size in range(1, SEED):
                short = np.where(counts == size, counts, 0)
                mask = np.repeat(counts == size, counts)
                parts.append(windows(words[mask], short, size))
                sizes.append(size)
            for (h, owner, place), size in zip(parts, sizes):
                owner_index = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item").take(owner_index), batch.column("item_id").take(owner_index),
                        pa.array(counts[owner]), pa.array(h.view(np.int64)), pa.array(place),
                        pa.array(np.full(len(h), size, np.int64)),
                    ],
                    ["item", "item_id", "n_words", "hash", "place", "size"],
                )

    rows = items.select(
        F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), whole(F.col("text")).alias("text")
    )
    return stored(
        rows.mapInArrow(run, "item long, item_id long, n_words long, hash long, place long, size long"), "item-seeds"
    )


def bit_table(seeds: DataFrame, bits: int = BITS) -> np.ndarray:
    """Words of 64 bits in which every seed's bit is set; their number is fixed."""
    slot = F.pmod("hash", F.lit(bits))
    words = seeds.select(
        F.shiftright(slot, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(hash, 64) as int))").alias("bit")
    ).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    # At most bits / 64 rows, whatever the number of items.
    table = np.zeros(bits // 64, np.int64)
    for batch in (words.toArrow().to_batches()):
        table[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return table.view(np.uint64)


def _seeded(table, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = Hashes(), table.value
        for batch in slices(batches, "text", WORK_BYTES):
            words, counts = word_hashes(batch.column("text").to_pylist(), known)
            for size in sizes:
                h, owner, place = windows(words, counts, size)
                # Spark's pmod of the signed value is the low bits.
                slot = h & np.uint64(len(bits) * 64 - 1)
                hit = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                owner_index = pa.array(owner[hit])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(owner_index), batch.column("doc_id").take(owner_index),
                        pa.array(h[hit].view(np.int64)), pa.array(place[hit]),
                    ],
                    ["row", "doc_id", "hash", "place"],
                )

    return run


def tiles(doc_places: np.ndarray, item_places: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in document, place in item, words) from matching seeds.

    Each pair of places is a match of `size` words.
    """
    seen = set(zip(doc_places.tolist(), item_places.tolist()))
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for d, i in seen:
        if (d - 1, i - 1) not in seen:
            n = size
            while (d + n - size + 1, i + n - size + 1) in seen:
                n += 1
            waiting[n].append((d, i))
    found: list[tuple[int, int, int]] = []
    doc_marks: set[int] = set()
    item_marks: set[int] = set()
    while waiting:
        n = max(waiting)
        for d, i in sorted(waiting.pop(n)):
            free = [d + k not in doc_marks and i + k not in item_marks for k in range(n)]
            if all(free):
                found.append((d, i, n))
                doc_marks.update(range(d, d + n))
                item_marks.update(range(i, i + n))
                continue
            start = None
            for k, ok in enumerate([*free, False]):
                if ok and start is None:
                    start = k
                elif not ok and start is not None:
                    if k - start >= size:
                        waiting[k - start].append((d + start, i + start))
                    start = None
    return found


def _tiled(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                places = np.array([(m["doc"], m["item"]) for m in row["matches"]], np.int64).reshape(-1, 2)
                found = tiles(places[:, 0], places[:, 1], row["size"])
                covered = sum(n for *_, n in found)
                if covered >= coverage * row["n_words"]:
                    out.append(
                        {
                            "row": row["row"], "doc_id": row["doc_id"], "item_id": row["item_id"],
                            "coverage": covered / row["n_words"], "n_tiles": len(found),
                            "longest": max(n for *_, n in found), "first_word": min(d for d, *_ in found),
                        }
                    )
            yield pa.RecordBatch.from_pylist(out, FOUND)

    return run


FOUND = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()),
        ("n_tiles", pa.int64()), ("longest", pa.int64()), ("first_word", pa.int64()),
    ]
)
FOUND_DDL = "row long, doc_id long, item_id long, coverage double, n_tiles long, longest long, first_word long"


def pairs(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Rows of FOUND for documents (row, doc_id, text) and items (item_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    seeds = item_seeds(items)
    sizes = [r["size"] for r in seeds.select("size").distinct().collect()]
    table = spark.sparkContext.broadcast(bit_table(seeds))
    hits = docs.mapInArrow(_seeded(table, sizes), "row long, doc_id long, hash long, place long")
    matched = hits.join(seeds.withColumnRenamed("place", "item_place"), "hash")
    grouped = matched.groupBy("row", "item").agg(
        F.any_value("doc_id").alias("doc_id"), F.any_value("item_id").alias("item_id"), F.any_value("n_words").alias("n_words"),
        F.any_value("size").alias("size"), F.size(F.collect_set("item_place")).alias("n_seeds"),
        F.collect_list(F.struct(F.col("place").alias("doc"), F.col("item_place").alias("item"))).alias("matches"),
    )
    enough = grouped.where(F.col("n_seeds") >= F.lit(coverage) * F.col("n_words") / F.col("size"))
    return enough.drop("n_seeds").mapInArrow(_tiled(coverage), FOUND_DDL)


def find(
    docs: DataFrame,
    items: DataFrame,
    *,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest, first_word) of each leaked item."""
    own = picked(docs, doc_id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text")
    )
    return pairs(own, picked(items, item_id=item_id_col, text=item_text_col), coverage).drop("row")


def without_leaks(
    docs: DataFrame, items: DataFrame, *, coverage: float = COVERAGE, text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of `docs`, all columns, whose text leaks no item.

    Equal texts leak alike, so rows go by a hash of their text.
    """
    key = F.xxhash64(F.md5(F.encode(whole(docs[text_col]), "utf-8")), whole(docs[text_col]))
    own = docs.select(F.monotonically_increasing_id().alias("row"), key.alias("doc_id"), whole(docs[text_col]).alias("text"))
    found = pairs(own, picked(items, item_id=item_id_col, text=item_text_col), coverage)
    leak_key = fresh(docs, "_leak_key")
    bad = stored(found.select(F.col("doc_id").alias(leak_key)).distinct(), "leaks")
    return docs.join(bad, key == F.col(leak_key), "left_anti")
