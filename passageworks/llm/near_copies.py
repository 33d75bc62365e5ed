"""Near-duplicates by ordered minima of shingles, verified by banded alignment.

A text is its lower-cased words in shingles of five, each labelled with the number of
its occurrence.  For every hash function the sketch takes the `PICKED` smallest labelled
shingles and keeps them in the order of the text, so that equal sketches speak for
texts that agree in content and in order.

Texts that share a sketch, or a run of three consecutive ones, are in one bucket; each is
compared with the first of the bucket in an order of the bucket's own.  A pair is a link when its alignment matches 0.8 of all labelled shingles of either
text: matched / (n + m - matched).  Labelled shingles are unique, so the alignment is the
longest chain of common ones that grows in both texts, among those whose places differ
by no more than the unmatched ones a link may have (the band).  Classes are the
connected components of the links; equal texts are one node from the start.

Comparing with the bucket's first finds most classes with work in proportion to
the texts.  What it leaves apart is then settled exactly: shingles have one order, rare
ones first, and two texts that are linked share one of the first n - ceil(0.8 n) + 1 of
theirs.  All pairs of different classes that meet in such a shingle are aligned, but for
those whose lengths or places there leave too few to match; no bucket is cut.  Pairs of one
class are never formed.  A shingle that is frequent is dropped if all its texts are of one
class; otherwise its texts are dealt into blocks, and every two blocks meet in a task.
Texts that have a partner there by lengths and places meet once more, with their prints.

Prints are compared before a pair's shingles are moved: a print has the parity of the
labelled shingles in each of some slots of their hashes, about two for each shingle.  Slots
that differ cannot outnumber the shingles that do, so a pair with more of them than a link
may have unmatched shingles is no link, and nothing else is dropped.

Defined cases: texts under five words are one shingle; null and empty texts are equal
texts without a word, and one class; case and punctuation do not count, equal texts
are equal by MD5; rows that repeat an id are in the class of their text; a class is
named by its smallest id, null where it has none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.batches import mixed, ragged, slices
from passageworks.llm.columns import fresh, picked, whole
from passageworks.llm.components import components
from passageworks.llm.suffixes import joined
from passageworks.session import remove_work, ship_package, stored, stored_at

WORDS, SIMILARITY = 5, 0.8
SKETCHES, PICKED = 16, 2
RUNS = (1, 3)
WORK_BYTES = 1 << 20
#: One text in `COUNTED` is counted for the order of the shingles, in slots of hashes.  The
#: order decides how many pairs meet and not which links are found.
COUNTED, OFTEN = 16, 4
SLOT_BITS = 20
MET_AT_ONCE = 1 << 20
#: Least slots of a print.
PRINT_BITS = 256
#: From this level on shingles are looked at before their texts meet, in blocks of so many texts.
HOT_LEVEL, HOT_ROWS = 8, 8_192
#: Columns of the rows that meet.
MEETS = ("token", "cell", "side", "node", "root", "n", "place")
WORD = re.compile(r"\w+")
PLACE = np.uint64((1 << 30) - 1)
MULTIPLIERS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)


class Hashes:
    """Word -> 64-bit hash; to hash again is quicker than to remember, and holds nothing."""

    __getitem__ = staticmethod(xxhash.xxh3_64_intdigest)


def shingles(texts: list[str], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of all texts in order, and how many each has."""
    look, rows = known.__getitem__, []
    for text in texts:
        found = WORD.findall(text.lower())
        rows.append(np.fromiter(map(look, found), np.uint64, len(found)))
    sizes = np.array([len(r) for r in rows], np.int64)
    counts = np.where(sizes == 0, 0, np.maximum(sizes - WORDS + 1, 1))
    flat = np.concatenate([*rows, np.zeros(WORDS, np.uint64)])
    starts = np.cumsum(sizes) - sizes
    full = flat
    for k in range(1, WORDS):
        full = joined(full[: len(flat) - k], flat[k:])
    at = ragged(starts, counts)
    out = full[at]
    begins = np.cumsum(counts) - counts
    for i in np.flatnonzero((sizes > 0) & (sizes < WORDS)).tolist():
        x = np.array([sizes[i]], np.uint64)
        for h in rows[i]:
            x = joined(x, np.array([h]))
        out[begins[i]] = x[0]
    return labelled(out, np.repeat(np.arange(len(counts)), counts)), counts


def labelled(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Values mixed with the number of their occurrence in their text."""
    by = np.lexsort((values, owner))  # stable: places stay in order
    v, o = values[by], owner[by]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    times = np.empty(len(v), np.uint64)
    times[by] = (np.arange(len(v)) - first).astype(np.uint64)
    return mixed(values + times * np.uint64(0x9E3779B97F4A7C15))


def sketches(labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row per text with shingles: its ordered minima for each hash function."""
    begins = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(begins), SKETCHES), np.uint64)
    if not len(begins):
        return out
    places = np.arange(len(labels), dtype=np.uint64)
    for j, m in enumerate(MULTIPLIERS):
        key = ((labels * m) & ~PLACE) | places
        picks = []
        for _ in range(PICKED):
            low = np.minimum.reduceat(key, begins)
            at = (low & PLACE).astype(np.int64)
            # A text with fewer shingles takes its last one again.
            picks.append(np.where(low == np.uint64(0xFFFFFFFFFFFFFFFF), picks[-1], at) if picks else at)
            key[at[low != np.uint64(0xFFFFFFFFFFFFFFFF)]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        found = np.full(len(begins), j, np.uint64)
        for at in np.sort(np.stack(picks), axis=0):
            found = joined(found, labels[at])
        out[:, j] = found
    return out


def prefixes(
    labels: np.ndarray, counts: np.ndarray, levels: np.ndarray, similarity: float = SIMILARITY
) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each text in the common order, and how many.

    Texts that are `similarity` alike share at least ceil(similarity * n) shingles, so one
    at least of the n - ceil(similarity * n) + 1 first.
    """
    keys = (levels[(labels >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (
        labels >> np.uint64(8)
    )
    keys = keys[np.lexsort((keys, np.repeat(np.arange(len(counts)), counts)))]
    sizes = np.minimum(counts, counts - np.ceil(similarity * counts - 1e-9).astype(np.int64) + 1)
    return keys[ragged(np.cumsum(counts) - counts, sizes)], sizes


def prints(labels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of all texts' slots as bytes, and how many bytes each text has.

    A text has a power of two of slots, so that halves of a print can be added to compare it
    with a shorter one.
    """
    slots = 1 << np.ceil(np.log2(np.maximum(2 * counts, PRINT_BITS))).astype(np.int64)
    begins = np.cumsum(slots) - slots
    at = np.repeat(begins, counts) + (labels & np.repeat(slots - 1, counts).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(slots.sum())) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little"), slots // 8


def differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """In how many slots the prints of each pair differ, at the width of the shorter one."""
    a_size, b_size = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (a, b))
    out = np.zeros(len(a), np.int64)
    for size in np.unique(a_size << 32 | b_size).tolist():
        rows = np.flatnonzero((a_size == size >> 32) & (b_size == size & 0xFFFFFFFF))
        width = min(size >> 32, size & 0xFFFFFFFF)
        x, y = (
            np.bitwise_xor.reduce(np.frombuffer(c.take(pa.array(rows)).buffers()[2], np.uint8).reshape(len(rows), -1, width), axis=1)
            for c in (a, b)
        )
        out[rows] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def _allowed(a: pa.Array, b: pa.Array, both: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the prints of pairs, of so many shingles in `both` texts, allow a link."""
    return differing(a, b) <= both * (1 - similarity) / (1 + similarity) + 1e-6


def partners(
    group: np.ndarray, side: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float = SIMILARITY
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i and j of different roots that can be links, of rows sorted by group, side and root.

    All rows of side 0 in a group meet; those of side 1 meet those of side 2.  Texts of n and m
    shingles that are linked have `need` of them in common at least; before their first common
    one all are unmatched.
    """
    rows = len(group)
    if not rows:
        return
    last = np.append(np.flatnonzero(np.diff(group)), rows - 1)
    group_end = np.repeat(last + 1, np.diff(np.concatenate([[-1], last])))
    # Rows of a run do not meet each other: one root, or one side of two.
    run = (np.diff(group) != 0) | (np.diff(side) != 0) | ((side[1:] == 0) & (np.diff(root) != 0))
    last = np.append(np.flatnonzero(run), rows - 1)
    run_end = np.repeat(last + 1, np.diff(np.concatenate([[-1], last])))
    fan = group_end - run_end
    ends = np.cumsum(fan)
    cuts = np.unique(np.searchsorted(ends, np.arange(MET_AT_ONCE, ends[-1] + MET_AT_ONCE, MET_AT_ONCE), "left") + 1)
    for lo, hi in zip([0, *cuts.tolist()], cuts.tolist()):
        i = np.repeat(np.arange(lo, min(hi, rows)), fan[lo:hi])
        j = ragged(run_end[lo:hi], fan[lo:hi])
        need = similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6
        met = (root[i] != root[j]) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= need)
        met &= n[i] + n[j] - place[i] - place[j] >= 2 * need
        if met.any():
            yield i[met], j[met]


def meeting(
    group: np.ndarray, side: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray,
    similarity: float = SIMILARITY, prints: pa.Array | None = None,
) -> Iterator[np.ndarray]:
    """Pairs (a, b) of the nodes of `partners`; with `prints`, only those whose prints allow a link."""
    held, size = [], 0
    for i, j in partners(group, side, root, n, place, similarity):
        if prints is not None:
            met = _allowed(prints.take(pa.array(i)), prints.take(pa.array(j)), n[i] + n[j], similarity)
            i, j = i[met], j[met]
        a, b = node[i], node[j]
        held.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        size += len(a)
        if size > MET_AT_ONCE:
            yield np.unique(np.concatenate(held, axis=1), axis=1)
            held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held, axis=1), axis=1)


def matched(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity by banded alignment of two texts' labelled shingles, 0 if under the bound."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    need = similarity * (n + m) / (1 + similarity)
    if min(n, m) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = n + m - 2 * need
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < need:
        return 0.0
    chain = j[np.argsort(i)]
    length = len(chain)
    if (np.diff(chain) <= 0).any():
        ends: list[int] = []
        for x in chain.tolist():
            k = bisect_left(ends, x)
            ends[k : k + 1] = [x]
        length = len(ends)
    found = length / (n + m - length)
    return found if found >= similarity else 0.0


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary of as many values for each size."""
    offsets = np.concatenate([[0], np.cumsum(sizes * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _sketch(levels, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in slices(batches, "text", WORK_BYTES):
            labels, counts = shingles(batch.column("text").to_pylist(), known)
            found = np.zeros((len(counts), SKETCHES), np.uint64)
            found[counts > 0] = sketches(labels, counts)
            flat = pa.array(found.view(np.int64).ravel())
            offsets = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * SKETCHES)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array(counts),
                    pa.ListArray.from_arrays(offsets, flat), _packed(*prefixes(labels, counts, levels.value, similarity)),
                    _packed(*prints(labels, counts)),
                ],
                ["doc_id", "text_key", "n", "sketches", "prefix", "print"],
            )

    return run


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for batch in slices(batches, "text", WORK_BYTES):
        labels, _ = shingles(batch.column("text").to_pylist(), known)
        yield pa.RecordBatch.from_arrays([pa.array(labels.view(np.int64))], ["label"])


def _unfolded(hot: bool, level: int):
    """One row for each shingle of the prefixes that is, or is not, of `level` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "prefix", WORK_BYTES):
            packed = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("prefix")]
            sizes = np.array([len(x) for x in packed], np.int64)
            of, place = np.repeat(np.arange(len(sizes)), sizes), ragged(np.zeros(len(sizes), np.int64), sizes)
            token = np.concatenate(packed) if packed else np.empty(0, np.int64)
            taken = np.flatnonzero((token >> 56 >= level) == hot)
            of = of[taken]
            node, root, n = (batch.column(c).to_numpy()[of] for c in ("node", "root", "n"))
            columns = [token[taken], node, root, n.astype(np.int32), place[taken].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "root", "n", "place"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Rows of complete groups (token, cell), as a table and as group, side, node, root, n, place."""

    def columns(table: pa.Table) -> list[np.ndarray]:
        token, cell, *rest = (table[c].to_numpy().astype(np.int64) for c in MEETS)
        return [np.cumsum((np.diff(token, prepend=token[:1]) != 0) | (np.diff(cell, prepend=cell[:1]) != 0)), *rest]

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        # The last group may go on in the next batch.
        found = columns(held)
        cut = int(np.searchsorted(found[0], found[0][-1]))
        if cut:
            yield held.slice(0, cut).combine_chunks(), [c[:cut] for c in found]
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks(), columns(held)


def _partnered(similarity: float):
    """The rows that have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, (group, side, _, root, n, place) in _whole_groups(batches):
            kept = np.zeros(len(group), bool)
            for i, j in partners(group, side, root, n, place, similarity):
                kept[i] = kept[j] = True
            yield from table.filter(pa.array(kept)).to_batches()

    return run


def _meeting(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, columns in _whole_groups(batches):
            prints = table["print"].combine_chunks()
            prints = prints.chunk(0) if isinstance(prints, pa.ChunkedArray) else prints
            for met in meeting(*columns, similarity=similarity, prints=prints):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in met], ["a", "b"])

    return run


def _alike(similarity: float):
    """Of pairs those whose prints allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
            kept = _allowed(batch.column("a_print"), batch.column("b_print"), both, similarity)
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for batch in slices(batches, "text", WORK_BYTES):
        labels, counts = shingles(batch.column("text").to_pylist(), known)
        yield pa.RecordBatch.from_arrays([batch.column("node"), _packed(labels, counts)], ["node", "labels"])


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c) for c in ("a", "b", "a_labels", "b_labels"))
            for a, b, x, y in zip(*columns):
                found = matched(
                    np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity
                )
                if found:
                    out.append((a.as_py(), b.as_py(), found))
            names, kinds = ["a", "b", "similarity"], [pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 3, kinds)], names
            )

    return run


def keyed(docs: DataFrame) -> DataFrame:
    text = whole(F.col("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.encode(text, "utf-8")).alias("text_key"), text.alias("text")
    )


def frequencies(own: DataFrame) -> np.ndarray:
    """How often shingles of each slot of hashes are seen in some of the texts, as a power of two."""
    some = own.where(F.pmod(F.xxhash64("text_key"), F.lit(COUNTED)) == 0)
    often = some.mapInArrow(_labels, "label long").groupBy("label").count().where(F.col("count") >= OFTEN)
    slot = F.shiftrightunsigned("label", 64 - SLOT_BITS).cast("int").alias("slot")
    found = often.groupBy(slot).agg(F.max(F.floor(F.log2("count"))).cast("int").alias("level")).toArrow()
    levels = np.zeros(1 << SLOT_BITS, np.uint8)
    levels[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    return levels


def distinct_texts(own: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each text: node, text_key, rep_id (its smallest id), n, sketches, prefix, print; stored."""
    # A fixed size, whatever the input's.
    levels = own.sparkSession.sparkContext.broadcast(frequencies(own))
    rows = own.mapInArrow(
        _sketch(levels, similarity),
        "doc_id long, text_key string, n long, sketches array<long>, prefix binary, print binary",
    )
    texts = rows.groupBy("text_key").agg(
        F.min("doc_id").alias("rep_id"), *(F.first(c).alias(c) for c in ("n", "sketches", "prefix", "print"))
    )
    return stored(texts.withColumn("node", F.monotonically_increasing_id()), "texts")


def candidates(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs (a, b) of nodes to compare: each with its buckets' first."""
    keys = [
        F.xxhash64(F.lit(r), F.lit(j), *(F.col("sketches")[(j + i) % SKETCHES] for i in range(r)))
        for r in RUNS for j in range(SKETCHES)
    ]
    rows = texts.where("n > 0").select("node", "n", F.explode(F.array(*keys)).alias("bucket"))
    # Each bucket orders its texts in a way of its own.
    rank = F.struct(F.xxhash64("node", "bucket").alias("h"), F.col("node").alias("node"), F.col("n").alias("n"))
    firsts = (
        rows.groupBy("bucket").agg(F.min(rank).alias("other"), F.max("node").alias("hi"), F.min("node").alias("lo"))
        .where("lo < hi").select("bucket", "other")
    )
    met = rows.join(firsts, "bucket")
    alike = F.least("n", "other.n") >= F.lit(similarity) * F.greatest("n", "other.n")
    return (
        met.where((F.col("node") != F.col("other.node")) & alike)
        .select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b"))
        .distinct()
    )


def apart(texts: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All pairs (a, b) of nodes of different roots that can be links."""
    rows = texts.where("n > 0").join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "n", "prefix"
    )
    schema = "token long, node long, root long, n int, place int"
    hot, cold = (rows.mapInArrow(_unfolded(h, HOT_LEVEL), schema) for h in (True, False))
    mixed = (
        hot.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows"))
        .where("lo < hi").select("token", F.ceil(F.col("rows") / HOT_ROWS).cast("int").alias("ways"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("ways")).cast("int")
    # Every two blocks of a shingle have a cell of their own.
    dealt = hot.join(mixed, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cell = F.least("own", "other").cast("long") * F.col("ways") + F.greatest("own", "other")
    tokens = (
        dealt.withColumns({"cell": cell, "side": side}).select(*MEETS)
        .unionByName(cold.withColumns({"cell": F.lit(0).cast("long"), "side": F.lit(0)}).select(*MEETS))
    )

    def grouped(some: DataFrame) -> DataFrame:
        return some.repartition("token", "cell").sortWithinPartitions("token", "cell", "side", "root")

    met = grouped(tokens).mapInArrow(_partnered(similarity), tokens.schema)
    printed = met.join(texts.select("node", "print"), "node").select(*MEETS, "print")
    return grouped(printed).mapInArrow(_meeting(similarity), "a long, b long").distinct()


def alike(texts: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of pairs (a, b) of nodes those whose prints allow a link."""
    prints = texts.select("node", "n", "print")
    a, b = (prints.toDF(x, f"{x}_n", f"{x}_print") for x in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(_alike(similarity), "a long, b long")


def links(own: DataFrame, texts: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified ones (a, b, similarity) of pairs of nodes; stored."""
    spark = own.sparkSession
    likely, likely_path = stored_at(pairs, "near-pairs")
    needed = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = texts.join(needed, "node").select("node", "text_key", "rep_id")
    held = (
        own.join(wanted, "text_key").where(F.col("doc_id").eqNullSafe(F.col("rep_id")))
        .select("node", "text").dropDuplicates(["node"]).mapInArrow(_shingled, "node long, labels binary")
    )
    held, held_path = stored_at(held, "near-labels")
    a = held.select(F.col("node").alias("a"), F.col("labels").alias("a_labels"))
    b = held.select(F.col("node").alias("b"), F.col("labels").alias("b_labels"))
    found = stored(
        likely.join(a, "a").join(b, "b").mapInArrow(_verify(similarity), "a long, b long, similarity double"), "near-links"
    )
    remove_work(spark, likely_path)
    remove_work(spark, held_path)
    return found


def text_classes(own: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per distinct text: text_key, rep_id, root (a node) and class_id; stored."""
    texts = distinct_texts(own, similarity)
    roots = components(links(own, texts, alike(texts, candidates(texts, similarity), similarity), similarity))
    rest = links(own, texts, apart(texts, roots, similarity), similarity)
    if not rest.isEmpty():
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(edges.unionByName(rest.select("a", "b")))
    rooted = texts.select("node", "text_key", "rep_id").join(roots, "node", "left").select(
        "text_key", "rep_id", "node", F.coalesce("root", "node").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    return stored(rooted.join(named, "root"), "near-classes")


def classes(
    docs: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id and class_id, the smallest id of its class."""
    ship_package(docs.sparkSession)
    own = keyed(picked(docs, doc_id=id_col, text=text_col))
    found = text_classes(own, similarity).select("text_key", "class_id")
    return own.select("doc_id", "text_key").join(found, "text_key").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of the smallest id of each class; one for each class."""
    ship_package(docs.sparkSession)
    found = text_classes(keyed(picked(docs, doc_id=id_col, text=text_col)), similarity)
    # Where a class has no id at all, its smallest node stays.
    first = found.groupBy("root").agg(
        F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), "rep_id", "node", "text_key")).alias("f")
    ).select("f.text_key", "f.rep_id")
    own_key, keep_key, keep_id = (fresh(docs, c) for c in ("_own_key", "_keep_key", "_keep_id"))
    first = first.toDF(keep_key, keep_id)
    key = F.md5(F.encode(whole(docs[text_col]), "utf-8"))
    rows = docs.withColumn(own_key, key).join(
        first, (F.col(own_key) == F.col(keep_key)) & docs[id_col].cast("long").eqNullSafe(F.col(keep_id))
    )
    return rows.dropDuplicates([own_key]).select(*docs.columns)
