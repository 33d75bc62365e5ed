"""Removal of repeated byte strings, by refining buckets of sampled suffixes.

A byte is removed when a string of `LEAST` bytes that covers it also starts earlier.

Every place of a text has bucket identifiers for its next 1, 2, 4 .. 64 bytes; each
comes from two of half the length, at the place and at a later offset, so longer ones
reuse the shorter.  Each window of `LEAST` bytes has one anchor, its 32-byte string of
the smallest identifier (the leftmost).  The choice depends on the window only, so equal
windows have their anchors at the same offset, and neighbouring windows mostly share
one: a text has an anchor for a run of windows about every 35 bytes.

Anchors of equal 32-byte strings form the initial buckets.  A bucket is refined by the
identifiers at the offsets around the anchor that its windows reach: runs that agree in
all of them have equal windows, so all but the earliest are repeats.  Only the earliest
runs of buckets that hold several different contexts need more.  Their windows have four
parts, by the offset of the anchor; the windows of a part have 83 bytes or more in common, and
only where runs of different contexts agree in those can windows be equal.  These windows are
refined one by one, by the identifiers of 64 bytes at the start and at offset 36.

Copies inside one batch are settled before the shuffle, so a string in a third of all
texts reaches its bucket once for each batch.  Texts longer than `SEGMENT` are worked on
in overlapping segments.  Identifiers have 64 bits; runs are compared by two of them.

Defined cases: a null text is empty; texts under `LEAST` bytes keep everything; null ids
come before all others; rows of equal id come in the order of a hash of their texts, and
rows that repeat id and text are one document, each reporting its result; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageworks.llm.batches import mixed, ragged, slices
from passageworks.llm.columns import picked, whole
from passageworks.session import ship_package, stored

LEAST, ANCHOR = 100, 32
SEGMENT = 1 << 20
#: Parts of a run: the offsets of the anchor in their windows, first and last.
PARTS = ((0, 16), (17, 33), (34, 50), (51, LEAST - ANCHOR))
#: Bits of a part's identifier, and those of all parts; the offset of the anchor in the run is above.
PART_BITS = 14
SIDE_BITS = PART_BITS * len(PARTS)
#: Bits of a place: a byte offset below a 24-bit hash of the text.
OFFSET_BITS = 38
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULTIPLY, SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
POSITION = np.uint64((1 << 24) - 1)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of pairs of identifiers."""
    x = a * MULTIPLY
    x += b
    x ^= x >> np.uint64(29)
    x *= SPREAD
    x ^= x >> np.uint64(32)
    return x


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the 32 and of the 64 bytes at each place; `data` is padded by 128."""
    x, step, kept = BYTES[data], 1, []
    while step < 64:
        x = joined(x[:-step], x[step:])
        step *= 2
        if step >= ANCHOR:
            kept.append(x)
    return kept[0], kept[1]


class Piece:
    """Texts, or a segment of a long one, in one padded buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, base: int):
        self.data = np.concatenate([data, np.zeros(128, np.uint8)])
        self.starts, self.sizes, self.rows, self.base = starts, sizes, rows, base


def pieces(batch: pa.RecordBatch) -> Iterator[Piece]:
    """The texts of column `data`; segments overlap so that their windows do not."""
    column = batch.column("data")
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
    starts, sizes = at[:-1] - at[0], np.diff(at)
    if len(data) <= 4 * SEGMENT:
        yield Piece(data, starts, sizes, np.arange(len(column)), 0)
        return
    for i in range(len(column)):
        for s in range(0, max(1, int(sizes[i]) - LEAST + 1), SEGMENT):
            part = data[starts[i] + s : min(starts[i] + sizes[i], starts[i] + s + SEGMENT + LEAST - 1)]
            yield Piece(part, np.array([0]), np.array([len(part)]), np.array([i]), s)


def runs(p: Piece) -> dict[str, np.ndarray]:
    """Runs of windows that share an anchor: row, first window, windows, bucket, context, sides."""
    counts = np.maximum(p.sizes - LEAST + 1, 0)
    windows = ragged(p.starts, counts)
    if not len(windows):
        return {}
    id32, id64 = identifiers(p.data)
    key = id32 & ~POSITION
    key |= np.arange(len(key), dtype=np.uint64)
    reach, step = LEAST - ANCHOR + 1, 1
    while 2 * step <= reach:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < reach:
        key = np.minimum(key[: len(key) - (reach - step)], key[reach - step :])
    anchors = (key[windows] & POSITION).astype(np.int64)
    begin = np.flatnonzero(np.diff(anchors, prepend=-1))
    end = np.append(begin[1:], len(anchors)) - 1
    low, high, anchor = windows[begin], windows[end], anchors[begin]
    length = high - low + LEAST
    context = joined(id64[low], id64[low + np.minimum(52, length - 64)])
    context = joined(context, id64[low + length - 64])
    shape = ((anchor - low) * 256 + (high - low)).astype(np.uint64)
    context = joined(context, mixed(shape))
    own = np.repeat(np.arange(len(counts)), counts)[begin]
    return {
        "row": p.rows[own], "low": low - p.starts[own] + p.base, "more": high - low,
        "bucket": id32[anchor], "context": context, "sides": sides(id64, low, anchor),
    }


def sides(id64: np.ndarray, low: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The anchor's offset in each run, and bits of what the windows of each part have in common.

    The bits of a part without windows mean nothing.
    """
    packed = (anchor - low).astype(np.uint64) << np.uint64(SIDE_BITS)
    for i, (first, last) in enumerate(PARTS):
        start = np.maximum(anchor - first, 0)
        stop = np.minimum(start + LEAST - (last - first) - 64, len(id64) - 1)
        common = joined(id64[start], id64[stop]) >> np.uint64(64 - PART_BITS)
        packed |= common << np.uint64(PART_BITS * i)
    return packed


def earliest(order: tuple[np.ndarray, ...], keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Mask of the first of each equal `keys`; `order` decides, most important first."""
    by = np.lexsort((*reversed(order), *reversed(keys)))
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in keys:
        s = k[by]
        new[1:] |= s[1:] != s[:-1]
    mask = np.zeros(len(by), bool)
    mask[by] = new
    return mask


def unions(row: np.ndarray, low: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges of overlapping or touching ones, by row."""
    by = np.lexsort((low, row))
    row, low, stop = row[by], low[by], stop[by]
    if not len(row):
        return row, low, stop
    # Rows are apart by more than any offset, so one running maximum serves all.
    shift = (np.cumsum(np.diff(row, prepend=row[0]) != 0)) * (np.int64(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + shift)
    new = np.append(True, (low + shift)[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], low[first], reach[last] - shift[last]


def document_order(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row by (id, hash), nulls first, equal for equal ones; and the hashes."""
    ids = batch.column("doc_id")
    null = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy()
    tie = batch.column("tie").to_numpy()
    by = np.lexsort((tie, number, ~null))
    new = np.append(False, (np.diff(number[by]) != 0) | (np.diff(tie[by]) != 0) | (null[by][1:] != null[by][:-1]))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    return rank, tie


RUNS = "kind int, bucket long, context long, doc_id long, place long, more int"
SIDED = RUNS + ", sides long"


def _rows(batch, kind, bucket, context, row, place, more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(row), kind, np.int32)), pa.array(bucket.view(np.int64)), pa.array(context.view(np.int64)),
            batch.column("doc_id").take(pa.array(row)), pa.array(place), pa.array(more.astype(np.int32)),
        ],
        ["kind", "bucket", "context", "doc_id", "place", "more"],
    )


def _sided(rows: pa.RecordBatch, packed: np.ndarray) -> pa.RecordBatch:
    return rows.append_column("sides", pa.array(packed.view(np.int64)))


def _settled(batch, tie, row, low, stop) -> pa.RecordBatch:
    """Ranges known to be repeats: kind 1, spread by their text, length in `more`."""
    row, low, stop = unions(row, low, stop)
    spread = mixed((tie[row] + 1).astype(np.uint64))
    return _rows(batch, 1, spread, np.zeros(len(row), np.uint64), row, (tie[row] << OFFSET_BITS) | low, stop - low)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "data", SEGMENT):
        rank, tie = document_order(batch)
        for piece in pieces(batch):
            r = runs(piece)
            if not r:
                continue
            place = (tie[r["row"]] << OFFSET_BITS) | r["low"]
            order = (rank[r["row"]], r["low"])
            first = earliest(order, (r["bucket"], r["context"]))
            # Rows that repeat id and text are one document: not repeats of each other.
            again = ~first & ~_same_place(r, order, first)
            f = first
            yield _sided(_rows(batch, 0, r["bucket"][f], r["context"][f], r["row"][f], place[f], r["more"][f]), r["sides"][f])
            if again.any():
                low = r["low"][again]
                rows = _settled(batch, tie, r["row"][again], low, low + r["more"][again] + LEAST)
                yield _sided(rows, np.zeros(rows.num_rows, np.uint64))


def _same_place(r: dict, order: tuple[np.ndarray, ...], first: np.ndarray) -> np.ndarray:
    """Mask of entries at the very place (document and offset) of a first one."""
    places = order[0] * (np.int64(order[1].max()) + 1) + order[1]
    return np.isin(places, places[first]) & ~first & _twice(places)


def _twice(values: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tie (24-bit hash of the text) and the text's bytes."""
    text = whole(F.col("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).bitwiseAND(F.lit((1 << 24) - 1)).alias("tie"),
        F.encode(text, "utf-8").alias("data"),
    )


def _with_data(batch: pa.RecordBatch, data: list[bytes]) -> pa.RecordBatch:
    at = batch.schema.get_field_index("data")
    return batch.set_column(at, "data", pa.array(data, pa.binary()))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches, "data", 4 * SEGMENT):
        yield _with_data(batch, [packer.compress(x.as_py()) for x in batch.column("data")])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about `SEGMENT` bytes of text, one row at least."""
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        held, size, begin = [], 0, 0
        for i, x in enumerate(batch.column("data")):
            held.append(opener.decompress(x.as_buffer()))
            size += len(held[-1])
            if size >= SEGMENT or i + 1 == batch.num_rows:
                yield _with_data(batch.slice(begin, len(held)), held)
                held, size, begin = [], 0, i + 1


def compressed(own: DataFrame) -> DataFrame:
    """`own` with compressed bytes, to be shuffled to their ranges."""
    return own.mapInArrow(_compressed, "doc_id long, tie long, data binary")


def later(keys: list[str]) -> Column:
    """Whether a row's (doc_id, place) comes after the first of its `keys`."""
    head = F.first(F.struct("doc_id", "place")).over(Window.partitionBy(*keys).orderBy("doc_id", "place"))
    return ~head.eqNullSafe(F.struct("doc_id", "place"))


def tie_of(place: Column) -> Column:
    return F.shiftrightunsigned(place, OFFSET_BITS)


def offset_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))


def refined(found: DataFrame) -> DataFrame:
    """Rows of SIDED after one refinement: (doc_id, tie, kind, low, more, bucket, context, sides); stored.

    Kind 1 is a range of repeats with its length, kind 2 a run whose windows differ
    in context from another run of its bucket; it alone has the last three.
    """
    bucket = Window.partitionBy("bucket")
    marked = found.repartition("bucket").select(
        "kind", "doc_id", "place", "more", "bucket", "context", "sides",
        later(["bucket", "context"]).alias("again"),
        (F.min("context").over(bucket) != F.max("context").over(bucket)).alias("mixed"),
    )
    kind = F.when((F.col("kind") == 1) | F.col("again"), 1).when(F.col("mixed"), 2)
    length = F.when(F.col("kind") == 1, F.col("more")).otherwise(F.col("more") + LEAST)
    return stored(
        marked.select(
            "doc_id", tie_of(F.col("place")).alias("tie"), kind.alias("kind"), offset_of(F.col("place")).alias("low"),
            F.when(kind == 1, length).otherwise(F.col("more")).alias("more"),
            *(F.when(kind == 2, F.col(c)).alias(c) for c in ("bucket", "context", "sides")),
        ).where("kind is not null"),
        "refined-runs",
    )


def open_parts(open_runs: DataFrame) -> DataFrame:
    """(doc_id, tie, low, more): the windows of the parts of runs that agree with a part of
    another context in what all their windows have in common."""
    anchor = F.col("low") + F.shiftrightunsigned("sides", SIDE_BITS)
    mask = F.lit((1 << PART_BITS) - 1)
    parts = F.array(*(
        F.struct(
            F.lit(i).alias("part"), F.shiftrightunsigned("sides", PART_BITS * i).bitwiseAND(mask).alias("common"),
            F.greatest(F.col("low"), anchor - last).alias("from"),
            F.least(F.col("low") + F.col("more"), anchor - first).alias("to"),
        )
        for i, (first, last) in enumerate(PARTS)
    ))
    rows = open_runs.repartition("bucket").select("doc_id", "tie", "bucket", "context", F.inline(parts)).where("from <= to")
    alike = Window.partitionBy("bucket", "part", "common")
    return (
        rows.withColumn("mixed", F.min("context").over(alike) != F.max("context").over(alike))
        .where("mixed")
        .select("doc_id", "tie", F.col("from").alias("low"), (F.col("to") - F.col("from")).alias("more"))
    )


def with_ranges(docs: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """`docs` with the array `ranges` of their (low, more)."""
    grouped = ranges.groupBy(F.col("doc_id").alias("id"), F.col("tie").alias("t")).agg(
        F.collect_list(F.struct("low", "more")).alias("ranges")
    )
    return docs.join(grouped, docs["doc_id"].eqNullSafe(grouped["id"]) & (docs["tie"] == grouped["t"]), how).drop("id", "t")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(_unpacked(batches), "data", SEGMENT):
        rank, tie = document_order(batch)
        wanted = batch.column("ranges")
        counts = wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = wanted.flatten()
        owner = np.repeat(np.arange(batch.num_rows), counts)
        low_all, more_all = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("low", "more"))
        for p in pieces(batch):
            id32, id64 = identifiers(p.data)
            slot = np.full(batch.num_rows, -1)
            slot[p.rows] = np.arange(len(p.rows))
            mine = slot[owner] >= 0
            s, low, stop = slot[owner[mine]], low_all[mine], low_all[mine] + more_all[mine] + 1
            low, stop = np.maximum(low, p.base), np.minimum(stop, p.base + p.sizes[s] - LEAST + 1)
            full = stop > low
            s, low, stop = s[full], low[full], stop[full]
            if not len(s):
                continue
            offset = ragged(low, stop - low)
            s = np.repeat(s, stop - low)
            at = p.starts[s] + offset - p.base
            key, middle, row = joined(id64[at], id64[at + LEAST - 64]), id32[at + 34], p.rows[s]
            order = (rank[row], offset)
            first = earliest(order, (key, middle))
            again = ~first & ~_same_place({}, order, first)
            place = (tie[row] << OFFSET_BITS) | offset
            f = first
            yield _rows(batch, 0, key[f], middle[f], row[f], place[f], np.zeros(f.sum(), np.int32))
            if again.any():
                yield _settled(batch, tie, row[again], offset[again], offset[again] + LEAST)


def window_repeats(docs: DataFrame, open_runs: DataFrame) -> DataFrame:
    """(doc_id, tie, low, more): ranges of single windows that repeat earlier ones; stored."""
    rows = with_ranges(compressed(docs), open_runs, "inner").select("doc_id", "tie", "data", "ranges").mapInArrow(_windows, RUNS)
    marked = rows.repartition("bucket").withColumn("again", later(["bucket", "context"]))
    length = F.when(F.col("kind") == 1, F.col("more")).otherwise(F.lit(LEAST))
    return stored(
        marked.where("kind = 1 or again").select(
            "doc_id", tie_of(F.col("place")).alias("tie"), offset_of(F.col("place")).alias("low"), length.alias("more")
        ),
        "repeated-windows",
    )


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            out = []
            for doc, data, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "ranges"))):
                removed, spans, kept = 0, 0, data
                if ranges:
                    low = np.array([r["low"] for r in ranges])
                    stop = low + np.array([r["more"] for r in ranges])
                    _, low, stop = unions(np.zeros(len(low), np.int64), low, stop)
                    removed, spans = int((stop - low).sum()), len(low)
                    edges = [0, *np.stack([low, stop], 1).ravel().tolist(), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (doc, len(data), removed, spans, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_text else row)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
            columns = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def deduplicate(
    docs: DataFrame, *, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: the columns of KEPT and, if asked for, `kept`, the remaining bytes.

    The remaining bytes need not be UTF-8: strings are cut where they repeat.
    """
    ship_package(docs.sparkSession)
    own = keyed(picked(docs, doc_id=id_col, text=text_col))
    found = refined(own.mapInArrow(_runs, SIDED))
    repeats = found.where("kind = 1").select("doc_id", "tie", "low", "more").unionByName(
        window_repeats(own, open_parts(found.where("kind = 2"))).select("doc_id", "tie", "low", F.col("more").cast("int").alias("more"))
    )
    return with_ranges(compressed(own), repeats, "left").select("doc_id", "data", "ranges").mapInArrow(
        _cut(with_text), KEPT + (", kept binary" if with_text else "")
    )
