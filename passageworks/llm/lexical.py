"""Ranked lexical search without a document index: an automaton of all query terms scans the texts.

The terms of all items become one Aho-Corasick automaton, each guarded by a space on
either side, so that it matches whole terms only.  Texts are made plain first: letters
A-Z lower-cased, all that is not part of a term one space.  The automaton then finds every
occurrence of every term in one pass; each output is a term's number, which maps to the items
that have the term.

Documents are scanned once.  What the scan keeps of a document are its length in terms and
the (term, occurrences) pairs that it holds; the corpus counts that the weights need (N, L and
each term's document frequency) come from those.  A second pass over the kept pairs scores
blocks of documents against all items and keeps, for each item, the best so far; a task
sends on at most as many rows as an item may have.  A pass over one in `SEEDED` of the
documents comes first: its last kept score is no more than the true one, so it bounds what tasks
send, and the result is the same without it.

Items are taken in blocks whose terms fit `TERMS` and `TERM_BYTES`, so that what is broadcast
is bounded; each block scans the documents.  Only a single item with more terms than that is
a block beyond the bound, as large as its own text.

Defined cases: null texts, and texts without a term, are no documents; rows that repeat a document id
are documents of their own, and null ids come last among equal scores; rows that repeat an
item id are one item with the terms of all; items without a term, or whose terms no document
has, have no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passageworks.llm.batches import ragged, slices
from passageworks.llm.columns import picked, whole
from passageworks.session import ship_package, stored

BEST = 50
#: What is not part of a term, and a term.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of a block of items, counted for each item, and their bytes.
TERMS, TERM_BYTES = 1 << 17, 4 << 20
SEEDED = 64
WORK_BYTES = 1 << 20
#: Scores of a block of documents that are held at once, and (document, item) pairs of a term.
CELLS, PAIRS = 1 << 21, 1 << 20
_NO_ID = np.iinfo(np.int64).max


def plain(texts: pa.Array) -> pa.Array:
    """The terms of each text between single spaces; empty where there is none."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=GAPS, replacement=" ")
    return pc.ascii_trim(spaced, " ")


@dataclass(frozen=True)
class Items:
    """A block of items: ids, distinct terms, and the items of each term (ranges of `item`)."""

    ids: list[int | None]
    terms: list[str]
    starts: np.ndarray
    item: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int | None, list[str]]]) -> Items:
        number: dict[str, int] = {}
        pairs = [(number.setdefault(t, len(number)), i) for i, (_, terms) in enumerate(rows) for t in terms]
        term, item = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(number)))])
        return Items([i for i, _ in rows], list(number), starts, item[order])

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            found.add_word(f" {term} ", i)
        found.make_automaton()
        return found


def item_terms(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): distinct; stored."""
    own = picked(items, item_id=id_col, text=text_col)
    terms = F.regexp_extract_all(F.translate(whole(F.col("text")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    pairs = own.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms).alias("term")).distinct()
    return stored(pairs, "item-terms")


def blocks(terms: DataFrame, most: int = TERMS, most_bytes: int = TERM_BYTES) -> Iterator[Items]:
    """All items, in blocks within the bounds; one block's terms at a time reach the driver."""
    each = F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("b")
    total = terms.agg(*each, F.count_distinct(F.coalesce("item_id", F.lit(0))).alias("items")).first()
    ways = max(1, -(-total["n"] // most), -(-(total["b"] or 0) // most_bytes))
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(ways))
        over = (F.col("n") > most) | (F.col("b") > most_bytes)
        several = F.min("item_id").alias("lo"), F.max("item_id").alias("hi"), F.count_if(F.col("item_id").isNull()).alias("none")
        sizes = terms.groupBy(block.alias("block")).agg(*each, *several)
        split = sizes.where(over & ((F.col("lo") < F.col("hi")) | ((F.col("none") > 0) & F.col("lo").isNotNull())))
        if split.isEmpty():
            break
        ways *= 2
    for k in range(ways):
        rows = terms.where(block == k).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
        found = [(r["item_id"], r["terms"]) for r in rows.orderBy("item_id").collect()]
        if found:
            yield Items.of(found)


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in slices(batches, "text", WORK_BYTES):
            texts = plain(batch.column("text"))
            full = pc.not_equal(texts, "")
            texts, ids = texts.filter(full), batch.column("doc_id").filter(full)
            if not len(texts):
                continue
            lengths = pc.add(pc.count_substring(texts, " "), 1).cast(pa.int64())
            # One string for the batch: texts apart by a space on either side of a break.
            sizes = pc.utf8_length(texts).to_numpy() + 3
            joined = "".join([f" {t} \n" for t in texts.to_pylist()])
            found = np.fromiter((x for hit in automaton.iter(joined) for x in hit), np.int64)
            at, term = found[::2], found[1::2]
            doc = np.searchsorted(np.cumsum(sizes), at, "right")
            pair, tf = np.unique(doc << 32 | term, return_counts=True)
            per_doc = np.bincount(pair >> 32, minlength=len(texts))
            offsets = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, lengths,
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array((pair & 0xFFFFFFFF).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf.astype(np.int32))),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    return run


def scanned(texts: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term: occurrences of the items' terms; stored."""
    shared = texts.sparkSession.sparkContext.broadcast(items)
    found = texts.mapInArrow(_scan(shared), "doc_id long, n long, terms array<int>, tfs array<int>")
    return stored(found, "lexical-hits")


def _frequencies(terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            held = batch.column("terms").flatten().to_numpy()
            total += np.bincount(held, minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["term", "df"])

    return run


def frequencies(hits: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term occurs; one number for each of a block's terms."""
    found = hits.select("terms").mapInArrow(_frequencies(terms), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(terms, np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


class BestRows:
    """The `most` best (score, document) of each item; equal scores by the smaller document."""

    def __init__(self, items: int, most: int, least: np.ndarray):
        self.most, self.least = most, least.copy()
        none = np.empty(0, np.int64)
        self.kept = [none, none, none]
        self.new: list[list[np.ndarray]] = []
        self.waiting, self.room = 0, max(1 << 16, 2 * items * most)

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        self.new.append([item, score, doc])
        self.waiting += len(item)
        if self.waiting > self.room:
            self.shrink()

    def shrink(self) -> list[np.ndarray]:
        item, score, doc = (np.concatenate(c) for c in zip(self.kept, *self.new))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        last = place == self.most - 1
        self.least[item[last]] = np.maximum(self.least[item[last]], score[last])
        keep = place < self.most
        self.kept, self.new, self.waiting = [item[keep], score[keep], doc[keep]], [], 0
        return self.kept


def _score(shared, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms, least = shared.value
        width = len(items.ids)
        best = BestRows(width, most, least)
        per_term = np.diff(items.starts)
        docs_at_once = max(1, CELLS // width)
        for batch in batches:
            for start in range(0, batch.num_rows, docs_at_once):
                part = batch.slice(start, docs_at_once)
                docs = part.column("doc_id").fill_null(_NO_ID).to_numpy()
                size = part.column("n").to_numpy()
                # Lengths against the mean length, in hundredths.
                length = 100 - 50 + (50 * size * n_docs) // n_terms
                held = pc.list_value_length(part.column("terms")).to_numpy()
                term = part.column("terms").flatten().to_numpy()
                tf = part.column("tfs").flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), held)
                worth = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[row]))
                scores = np.zeros(part.num_rows * width)
                # Sums of whole numbers under 2**53: exact in doubles.
                ends = np.cumsum(per_term[term])
                cuts = np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS), "right")
                for a, b in zip([0, *cuts], [*cuts, len(term)]):
                    if a < b:
                        fan = per_term[term[a:b]]
                        to = items.item[ragged(items.starts[term[a:b]], fan)]
                        cell = np.repeat(row[a:b] * width, fan) + to
                        lo, hi = int(row[a]) * width, (int(row[b - 1]) + 1) * width
                        scores[lo:hi] += np.bincount(cell - lo, np.repeat(worth[a:b], fan).astype(np.float64), hi - lo)
                table = scores.reshape(part.num_rows, width)
                at, item = np.nonzero(table >= best.least)
                best.offer(item, table[at, item].astype(np.int64), docs[at])
        item, score, doc = best.shrink()
        if len(item):
            ids = pa.array(items.ids, pa.int64()).take(pa.array(item))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(doc, mask=doc == _NO_ID), pa.array(score)], ["item_id", "doc_id", "score"]
            )

    return run


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _block(texts: DataFrame, items: Items, most: int) -> DataFrame:
    hits = scanned(texts, items)
    n_docs, n_terms = hits.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = frequencies(hits, len(items.terms))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    if n_docs and len(items.ids) and int(weights.max()) * 1_000_000 * int(np.bincount(items.item).max()) >= 1 << 53:
        raise ValueError("an item has too many terms for exact sums")
    context = texts.sparkSession.sparkContext

    def scored(some: DataFrame, least: np.ndarray) -> DataFrame:
        shared = context.broadcast((items, weights, n_docs, n_terms or 1, least))
        return some.mapInArrow(_score(shared, most), "item_id long, doc_id long, score long")

    lowest = np.ones(len(items.ids), np.int64)
    seed = scored(hits.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEEDED)) == 0), lowest)
    known = {r["item_id"]: r["score"] for r in _ranked(seed, most).where(F.col("rank") == most).collect()}
    return scored(hits, np.array([known.get(i, 1) for i in items.ids], np.int64))


def search(
    docs: DataFrame, items: DataFrame, *, most: int = BEST,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` best documents of each item, scores above 0."""
    spark = docs.sparkSession
    ship_package(spark)
    own = picked(docs, doc_id=id_col, text=text_col)
    texts = own.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in blocks(item_terms(items, id_col=item_col, text_col=item_text_col)):
        found = found.unionByName(_block(texts, block, most))
    return _ranked(found, most).select("item_id", "rank", "doc_id", "score")
