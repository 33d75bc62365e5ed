"""Exact nearest chunks for a table of questions.

Distances are Euclidean.  Each task scores its chunks against a block of
questions with one matrix product per Arrow batch and keeps the k nearest per
question, so at most k rows per question leave a task: the pairs themselves are
never rows.  The product, in single precision, only preselects, with a margin
over its largest possible rounding error; kept distances are computed from
differences in double precision and rounded to `TIE_DECIMALS`, and ties go to
the smaller chunk id.

Questions are broadcast when they fit `MAX_QUESTIONS` and `MAX_QUESTION_BYTES`.
A larger question table is searched block by block: each block is broadcast in turn and
meets all chunks where they are, so that no vector of a chunk is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passageworks.functions.vectors import TIE_DECIMALS
from passageworks.session import shared, stored, work_path, work_scope

MAX_QUESTIONS = 16_384
MAX_QUESTION_BYTES = 128 << 20
# A result proven to have at most this many (short) rows may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000
MAX_LITERAL_GROUPS = 1_000
# From this size on, results of a question are merged in two steps.
THIN_BYTES, THIN_WAYS = 64 << 30, 32
# Questions of one block, and rows of chunks that a task scores against them at a time.
BLOCK_QUESTIONS = 16_384
BLOCK_CHUNKS, BLOCK_CHUNK_BYTES = 16_384, 32 << 20

_TILE_ROWS, _TILE_QUESTIONS, _EXACT_PAIRS, _FIRST_ROWS = 16_384, 1_024, 1_024, 4_096
_TIE = 10.0**-TIE_DECIMALS
_NULL = np.iinfo(np.int64).min


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as a matrix of its type; rows must have equal widths."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) == 0:
        return np.zeros((0, 0), np.float32)
    widths = pc.min_max(vectors.value_lengths()).as_py()
    if widths["min"] != widths["max"] or vectors.null_count:
        raise ValueError(f"vectors of different or missing widths: {widths}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), widths["min"])


@dataclass(frozen=True)
class Questions:
    """A question table and, when it is within the bounds, its rows.

    Gather it once to search several times: the vectors are then computed once.
    """

    frame: DataFrame
    qids: np.ndarray | None = None
    vectors: np.ndarray | None = None

    @property
    def small(self) -> bool:
        return self.qids is not None


def gather(questions: DataFrame, max_questions: int = MAX_QUESTIONS) -> Questions:
    """Read (qid, embedding); at most `max_questions` + 1 rows reach the driver."""
    # A repeated qid is one question: that of the smallest vector.
    frame = (
        questions.select(F.col("qid").cast("long"), F.col("embedding"))
        .groupBy("qid").agg(F.min("embedding").alias("embedding"))
    )
    rows = frame.limit(max_questions + 1).toArrow()
    if rows.num_rows <= max_questions:
        vectors = matrix(rows["embedding"]).astype(np.float64)
        if vectors.nbytes <= MAX_QUESTION_BYTES:
            return Questions(frame, rows["qid"].to_numpy(), vectors)
    return Questions(frame)


class NearestRows:
    """The k nearest rows of each lane, a lane being one list to fill."""

    def __init__(self, lanes: int, k: int, bounds: np.ndarray | None = None):
        self.k = k
        self.bounds = np.full(lanes, np.inf) if bounds is None else bounds.copy()
        none = np.empty(0, np.int64)
        self._kept = [none, np.empty(0), none, none]
        # k rows of the lane are known to be at most as far as this.
        self._kth = np.full(lanes, np.inf)
        self._new: list[list[np.ndarray]] = []
        self._waiting = 0
        self._room = max(1 << 16, lanes * k)

    def offer(
        self,
        ids: np.ndarray,
        carried: np.ndarray,
        rows: np.ndarray,
        lanes: np.ndarray,
        points: np.ndarray,
    ) -> None:
        """Score `rows` against `points`, one point per lane.  `ids` break ties;
        `carried` is kept along with them."""
        for r in range(0, len(rows), _TILE_ROWS):
            tile = slice(r, r + _TILE_ROWS)
            for q in range(0, len(lanes), _TILE_QUESTIONS):
                some = slice(q, q + _TILE_QUESTIONS)
                self._tile(ids[tile], carried[tile], rows[tile], lanes[some], points[some])

    def _tile(self, ids, carried, x, lanes, p) -> None:
        x_single, p_single = x.astype(np.float32, copy=False), p.astype(np.float32, copy=False)
        x_norm = np.einsum("ij,ij->i", x_single, x_single)
        p_norm = np.einsum("ij,ij->i", p_single, p_single)
        # Squared distance less |p|², halved and negated: greater is nearer.
        near = p_single @ x_single.T
        near -= (x_norm * np.float32(0.5))[None, :]
        # A dot product of n terms is off by n half-ulps of |x||p| at most, the
        # norms likewise, and the conversions and sums by a few more.
        error = ((3 * x.shape[1] + 40) * np.float32(2.0**-24) * (x_norm.max() + p_norm)).astype(np.float64)
        p_norm = p_norm.astype(np.float64)
        if len(x) >= self.k and np.isinf(np.minimum(self._kth[lanes], self.bounds[lanes])).any():
            first = near[:, : max(self.k, _FIRST_ROWS)]
            place = first.shape[1] - self.k
            self._know(lanes, p_norm - 2.0 * np.partition(first, place, axis=1)[:, place] + error)
        limit = self._limit(lanes, error)
        floor = np.nextafter(((p_norm - limit) / 2).astype(np.float32), np.float32(-np.inf))
        at = np.flatnonzero(near >= floor[:, None])
        lane_at, row_at = np.divmod(at, len(x))
        if len(at) > self.k:  # only estimates so far: keep those that the best k of the lane allow
            far = p_norm[lane_at] - 2.0 * near.reshape(-1)[at]
            order = np.lexsort((far, lane_at))
            lane_at, row_at, far = lane_at[order], row_at[order], far[order]
            starts = np.searchsorted(lane_at, np.arange(len(lanes)))
            sizes = np.diff(np.r_[starts, len(lane_at)])
            full = np.flatnonzero(sizes >= self.k)
            self._know(lanes[full], far[starts[full] + self.k - 1] + error[full])
            kept = far <= self._limit(lanes, error)[lane_at]
            lane_at, row_at = lane_at[kept], row_at[kept]
        for i in range(0, len(lane_at), _EXACT_PAIRS):
            a, b = lane_at[i : i + _EXACT_PAIRS], row_at[i : i + _EXACT_PAIRS]
            diff = x[b].astype(np.float64) - p[a]
            d = np.round(np.sqrt(np.einsum("ij,ij->i", diff, diff)), TIE_DECIMALS)
            self._new.append([lanes[a], d, ids[b], carried[b]])
            self._waiting += len(a)
        if self._waiting > self._room:
            self._shrink()

    def _know(self, lanes: np.ndarray, squared: np.ndarray) -> None:
        """k rows of each of these lanes have at most this squared distance."""
        self._kth[lanes] = np.minimum(self._kth[lanes], np.sqrt(np.maximum(squared, 0.0)))

    def _limit(self, lanes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """The largest estimate of a squared distance that may be among the nearest."""
        reach = np.minimum(self.bounds[lanes], self._kth[lanes] + _TIE)
        return (reach + 2 * _TIE) ** 2 + error

    def _shrink(self) -> None:
        columns = [np.concatenate(c) for c in zip(self._kept, *self._new)]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        lane, d = columns[:2]
        first = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]]) if len(lane) else lane
        sizes = np.diff(np.r_[first, len(lane)])
        place = np.arange(len(lane)) - np.repeat(first, sizes)
        last = place == self.k - 1
        self.bounds[lane[last]] = np.minimum(self.bounds[lane[last]], d[last])
        keep = place < self.k
        self._kept = [c[keep] for c in columns]
        self._new, self._waiting = [], 0

    def result(self) -> list[np.ndarray]:
        """Lanes, distances, ids and carried values, in this order of sorting."""
        self._shrink()
        return self._kept


class _Lanes:
    """Lanes of one question block: their labels, points and groups."""

    def __init__(self, labels: pa.Table, points: np.ndarray, at: np.ndarray, merge: str | None):
        """`at` gives the point of each label row.  With `merge`, label rows of
        one question fill the same lane, else each fills its own."""
        self.labels, self.points, self.at = labels, points, at
        self.lane = at if merge else np.arange(len(at))
        self.lanes = len(points) if merge else len(at)
        self.names = labels
        if merge:
            first = np.zeros(len(points), np.int64)
            first[at[::-1]] = np.arange(len(at))[::-1]
            self.names = labels.take(pa.array(first)).select([merge])

    def by_group(self, groups: np.ndarray) -> dict[int, np.ndarray]:
        order = np.argsort(groups, kind="stable")
        keys, starts = np.unique(groups[order], return_index=True)
        return dict(zip(keys.tolist(), np.split(order, starts[1:])))


def _emit(best: NearestRows, names: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    lane, d, ids, carried = best.result()
    out = names.take(pa.array(lane))
    out = out.append_column("chunk_id", pa.array(ids, pa.int64()))
    out = out.append_column("_carried", pa.array(carried, pa.int64(), mask=carried == _NULL))
    out = out.append_column("d", pa.array(d, pa.float64()))
    yield from out.select(schema.names).cast(schema).to_batches(max_chunksize=16_384)


def _longs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(_NULL)).to_numpy()


def nearest(
    chunks: DataFrame,
    questions: DataFrame | Questions,
    k: int,
    *,
    chunk_id: str = "id",
    vector: str = "embedding",
    carry: str | None = None,
    group: str | None = None,
    routes: DataFrame | None = None,
    per_group: bool = False,
    seed_fraction: float = 0.0,
    max_questions: int = MAX_QUESTIONS,
    block_chunks: int = BLOCK_CHUNKS,
    block_questions: int = BLOCK_QUESTIONS,
    within: DataFrame | None = None,
) -> DataFrame:
    """(qid, chunk_id, d, rank): the `k` nearest chunks of each question.

    `questions` has qid and embedding, or was gathered before.  `carry` names an integer chunk column to
    keep.  With `routes` (qid, `group`, any labels)
    a question only sees the chunks of its groups; `per_group` then ranks within
    each (qid, group) and keeps the labels.

    `seed_fraction` first searches a random part of the chunks.  The k-th
    distance found there cannot be below the true one, so it bounds what tasks
    of the full pass emit: exact all the same, and worth it for very many tasks.
    It has no effect with routes or on question tables too large to be gathered.

    `within` (qid, reach) leaves out what is farther from a question than its reach.  A
    question table too large to be gathered is searched in blocks of `block_questions`
    when this is called, with a scan of `chunks` for each: they are best a written table.
    """
    if routes is not None and group is None:
        raise ValueError("routes need a group column")
    source = chunks.select(
        F.col(chunk_id).cast("long").alias("chunk_id"),
        F.col(carry).cast("long").alias("_carried") if carry else F.lit(0).cast("long").alias("_carried"),
        *([F.col(group).cast("long").alias("_group")] if group else []),
        F.col(vector).alias("_vector"),
    )
    asked = questions if isinstance(questions, Questions) else gather(questions, max_questions)
    labels = asked.frame.select("qid")
    if routes is not None:
        labels = routes.withColumns(
            {"qid": F.col("qid").cast("long"), "_group": F.col(group).cast("long")}
        )
        if not per_group:
            labels = labels.select("qid", "_group").distinct()
    keys = ["qid", group] if per_group else ["qid"]
    names = [f for f in labels.schema if f.name != "_group"]
    schema = (
        T.StructType(names).add("chunk_id", "long").add("_carried", "long").add("d", "double")
    )

    block = _bounded_block(asked, None if routes is None else labels)
    if block is None:
        result = _search_blocks(
            source, asked.frame, labels if routes is not None else None, within, keys, k, schema,
            block_chunks, block_questions,
        )
        return result.withColumnRenamed("_carried", carry) if carry else result.drop("_carried")
    if block.lanes == 0:
        found = chunks.sparkSession.createDataFrame([], schema)
    else:
        bounds = None
        if seed_fraction > 0 and routes is None:
            seed = _search_broadcast(source.sample(seed_fraction, seed=17), block, k, schema, None, block_chunks)
            bounds = _kth_distances(ranked(seed, keys, k, thin=_many_tasks(source)), block, k)
        if within is not None:
            bounds = _reaches(within.select("qid", "reach").toArrow(), block)
        found = _search_broadcast(source, block, k, schema, bounds, block_chunks)
    result = ranked(found, keys, k, thin=_many_tasks(source))
    result = result.withColumnRenamed("_carried", carry) if carry else result.drop("_carried")
    if block is not None and block.lanes * k <= MAX_BROADCAST_ROWS:
        return F.broadcast(result)  # a hint for a later join, and proven small
    return result


def _many_tasks(source: DataFrame) -> bool:
    """Whether the scan is estimated, from file sizes, to have very many tasks."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size > THIN_BYTES


def ranked(found: DataFrame, keys: Sequence[str], k: int, thin: bool = False) -> DataFrame:
    """Rank the rows of all tasks and keep `k` per key.

    A key has up to k rows from every task.  When tasks are many, the rows are
    thinned in several tasks per key before they meet in one.
    """
    near = [F.col("d"), F.col("chunk_id")]
    if thin:
        ways = F.pmod(F.xxhash64("chunk_id"), F.lit(THIN_WAYS)).alias("_way")
        found = (
            found.select("*", ways)
            .withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_way").orderBy(*near)))
            .filter(F.col("_r") <= k)
            .drop("_r", "_way")
        )
    return found.withColumn(
        "rank", F.row_number().over(W.partitionBy(*keys).orderBy(*near))
    ).filter(F.col("rank") <= k)


def _bounded_block(asked: Questions, labels: DataFrame | None) -> _Lanes | None:
    """Questions and routes on the driver, or None when they exceed the bounds."""
    if not asked.small:
        return None
    qids, vectors = asked.qids, asked.vectors
    if labels is None:
        return _Lanes(pa.table({"qid": qids}), vectors, np.arange(len(qids)), None)
    most = MAX_QUESTIONS * 16  # routes have no vectors
    routed = labels.limit(most + 1).toArrow()
    if routed.num_rows > most:
        return None
    merge = "qid" if routed.column_names == ["qid", "_group"] else None
    return _routed_lanes(qids, vectors, routed, merge)


def _routed_lanes(qids: np.ndarray, vectors: np.ndarray, routed: pa.Table, merge: str | None) -> _Lanes:
    order = np.argsort(qids)
    wanted = routed["qid"].to_numpy()
    place = np.searchsorted(qids[order], wanted)
    known = np.isin(wanted, qids)
    routed, place = routed.filter(pa.array(known)), place[known]
    return _Lanes(routed, vectors, order[place], merge)


def _search_broadcast(
    source: DataFrame,
    block: _Lanes,
    k: int,
    schema: T.StructType,
    bounds: np.ndarray | None,
    block_chunks: int,
    tasks: int | None = None,
) -> DataFrame:
    spark = source.sparkSession
    arrow_schema = to_arrow_schema(schema)
    grouped = "_group" in block.labels.column_names
    sent = shared(spark, (block, bounds))
    if grouped:
        source = _of_groups(source, block.labels["_group"].unique())

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, limits = sent.value
        best = NearestRows(b.lanes, k, limits)
        members = b.by_group(b.labels["_group"].to_numpy()) if grouped else {}
        for batch in _gathered(batches, block_chunks):
            x = matrix(batch["_vector"])
            ids, carried = _longs(batch["chunk_id"]), _longs(batch["_carried"])
            if not grouped:
                best.offer(ids, carried, x, b.lane, b.points[b.at])
                continue
            parts = b.by_group(batch["_group"].to_numpy())
            for g, rows in parts.items():
                mine = members.get(g)
                if mine is not None:
                    best.offer(
                        ids[rows], carried[rows], x[rows], b.lane[mine], b.points[b.at[mine]]
                    )
        yield from _emit(best, b.names, arrow_schema)

    columns = ["chunk_id", "_carried", *(["_group"] if grouped else []), "_vector"]
    rows = source.select(*columns)
    return (rows if tasks is None else rows.coalesce(tasks)).mapInArrow(search, schema)


def _of_groups(source: DataFrame, groups: pa.Array) -> DataFrame:
    """Only the chunks of routed groups, before they go to Python.

    A short list becomes a literal filter, which prunes partitions and row
    groups; a longer one a broadcast semi join, which prunes partitions when it runs,
    where groups are those of a partition column.  Its length is bounded by the number of
    routes, which were collected under a bound.
    """
    if len(groups) <= MAX_LITERAL_GROUPS:
        return source.filter(F.col("_group").isin(groups.to_pylist()))
    # A written table: the optimizer would fold the range into literal rows, and only
    # a side with a filter prunes the other.
    wanted = stored(source.sparkSession.createDataFrame(pa.table({"_group": groups})), "groups")
    wanted = wanted.filter(F.col("_group") >= pc.min(groups).as_py())
    return source.join(F.broadcast(wanted), "_group", "left_semi")


def _gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together up to `rows` or `BLOCK_CHUNK_BYTES`; empty ones are left out."""
    waiting, n, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= BLOCK_CHUNK_BYTES:
            yield pa.Table.from_batches(waiting)
            waiting, n, size = [], 0, 0
    if n:
        yield pa.Table.from_batches(waiting)


def _kth_distances(seed: DataFrame, block: _Lanes, k: int) -> np.ndarray:
    rows = seed.filter(F.col("rank") == k).select("qid", F.col("d").alias("reach")).toArrow()
    return _reaches(rows, block)


def _reaches(rows: pa.Table, block: _Lanes) -> np.ndarray:
    """How far each lane looks; without a row, as far as need be."""
    known = dict(zip(rows["qid"].to_pylist(), rows["reach"].to_pylist()))
    return np.array([known.get(q, np.inf) for q in block.names["qid"].to_pylist()])


def _search_blocks(
    source: DataFrame,
    points: DataFrame,
    labels: DataFrame | None,
    within: DataFrame | None,
    keys: Sequence[str],
    k: int,
    schema: T.StructType,
    block_chunks: int,
    block_questions: int,
) -> DataFrame:
    """Blocks of questions, one after the other, meet all chunks of their groups.

    Chunks are read in place by as many tasks as there are cores, so that only the k nearest
    of each task move.  A block comes to the driver compressed and alone, and its
    broadcast goes before the next.  Questions and routes may come from a whole search:
    they are packed once.
    """
    spark = source.sparkSession
    path, tasks = work_path(spark, "nearest"), spark.sparkContext.defaultParallelism
    result = T.StructType([*schema]).add("rank", "integer")
    spark.createDataFrame([], result).write.parquet(path)
    with work_scope():
        points = stored(points.filter("qid IS NOT NULL"), "questions")
        blocks = max(1, -(-points.count() // block_questions))
        if within is not None:
            points = points.join(within.select(F.col("qid").cast("long"), "reach"), "qid", "left")
        packed = stored(_packed(points, blocks), "packed")
        if labels is not None:
            labels = stored(_packed(labels.filter("_group IS NOT NULL"), blocks), "routes")
        for i in range(blocks):
            asked, routes = _unpacked(packed, i), None if labels is None else _unpacked(labels, i)
            if asked is None or (labels is not None and routes is None):
                continue
            qids, vectors = asked["qid"].to_numpy(), matrix(asked["embedding"]).astype(np.float64)
            if routes is None:
                block = _Lanes(asked.select(["qid"]), vectors, np.arange(len(qids)), None)
            else:
                block = _routed_lanes(qids, vectors, routes, "qid" if keys == ["qid"] else None)
            if block.lanes == 0:
                continue
            bounds = None
            if within is not None:
                bounds = _reaches(asked.filter(pc.is_valid(asked["reach"])), block)
            with work_scope():
                found = _search_broadcast(source, block, k, schema, bounds, block_chunks, tasks)
                ranked(found, keys, k).write.mode("append").parquet(path)
    return spark.read.schema(result).parquet(path)


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """(_block, data): rows dealt to blocks by their qid, each block compressed into one value."""

    def pack(table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        kept = table.drop_columns(["_block"])
        with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(kept)
        return pa.table({"_block": table["_block"][:1], "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("_block").applyInArrow(pack, "_block int, data binary")


def _unpacked(packed: DataFrame, block: int) -> pa.Table | None:
    row = packed.filter(F.col("_block") == block).select("data").first()
    return None if row is None else pa.ipc.open_stream(row.data).read_all()
