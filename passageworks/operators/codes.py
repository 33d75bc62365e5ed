"""Exact search over vectors of one byte per component.

A row's code is its vector divided by a scale of the row and rounded to whole numbers; the
residual is the distance from the vector to what the code stands for.  The distance of a
question to a code, less or plus the residual, bounds its distance to the vector.

A search scans the codes twice and never the vectors of rows that cannot win: the first scan
gives each question the k-th smallest of its upper bounds, its reach; the second marks the
rows that have a lower bound within the reach of some question.  Only the marked rows, and of
a table laid out by cells only the cells that hold some, are then searched in full.

What leaves a task is bounded in both scans: k bounds per question, and one short row per
marked chunk.  Equal vectors in any number are marked alike; the full search settles ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.functions import fixed
from passageworks.functions.vectors import TIE_DECIMALS
from passageworks.operators.nearest import Questions, gather, matrix, nearest, ranked
from passageworks.session import stored, stored_at

_LEVELS = 127
# Rounding of distances, which decides ties, and of the residuals.
_SLACK = 4 * 10.0**-TIE_DECIMALS
_ROWS, _LANES = 4_096, 1_024


@dataclass(frozen=True)
class Coded:
    """Hits, and how many vectors were read in full for them."""

    hits: DataFrame
    vectors_read: int


def code_rows(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """The other columns with `code` (a byte per component), `scale` and `residual`.

    Rows stay where they are.  A vector of zeros has code, scale and residual of zeros.
    """

    @F.arrow_udf("struct<code:binary,scale:double,residual:double>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            x = matrix(vectors).astype(np.float64)
            scale = np.abs(x).max(axis=1, initial=0.0) / _LEVELS
            code = np.rint(x / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.int8)
            diff = x - code * scale[:, None]
            residual = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            columns = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(residual)]
            yield pa.StructArray.from_arrays(columns, ["code", "scale", "residual"])

    keep = [c for c in chunks.columns if c != vector]
    return chunks.select(*keep, coded(F.col(vector)).alias("_c")).select(*keep, "_c.*")


def decoded(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors that the codes of a batch stand for."""
    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8)
    return codes.reshape(batch.num_rows, -1) * batch.column("scale").to_numpy()[:, None]


def bounds(x: np.ndarray, residual: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance of each point (row) to the vector of each code (column)."""
    x_norm, p_norm = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", points, points)
    squared = points @ x.T
    squared *= -2.0
    squared += p_norm[:, None]
    squared += x_norm[None, :]
    # Sums of n products are off by n half-ulps of |x||p| at most; norms and sums likewise.
    error = (3 * x.shape[1] + 40) * 2.0**-53 * (x_norm.max(initial=0.0) + p_norm)[:, None]
    far = residual * (1 + 1e-9) + _SLACK
    return np.sqrt(np.maximum(squared - error, 0.0)) - far, np.sqrt(np.maximum(squared + error, 0.0)) + far


def _tiles(batch: pa.RecordBatch, points: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, first lane, lower, upper) of blocks of bounded size."""
    x, residual = decoded(batch), batch.column("residual").to_numpy()
    for r in range(0, len(x), _ROWS):
        for q in range(0, len(points), _LANES):
            yield r, q, *bounds(x[r : r + _ROWS], residual[r : r + _ROWS], points[q : q + _LANES])


def reaches(codes: DataFrame, asked: Questions, k: int) -> np.ndarray:
    """The k-th smallest upper bound of each question; infinite where there are fewer rows."""
    spark = codes.sparkSession
    shared = spark.sparkContext.broadcast((asked.qids, asked.vectors))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, points = shared.value
        near = np.full((len(points), k), np.inf)
        for batch in batches:
            if batch.num_rows:
                for _, q, _, upper in _tiles(batch, points):
                    some = np.concatenate([near[q : q + _LANES], upper], axis=1)
                    near[q : q + _LANES] = np.partition(some, k - 1, axis=1)[:, :k]
        lane, place = np.nonzero(np.isfinite(near))
        table = pa.table({"qid": qids[lane], "d": near[lane, place]})
        yield from table.to_batches(max_chunksize=16_384)

    found = codes.select("code", "scale", "residual").mapInArrow(smallest, "qid long, d double")
    last = ranked(found.withColumn("chunk_id", F.monotonically_increasing_id()), ["qid"], k, thin=True)
    # One row per question, whose number is bounded.
    rows = last.filter(F.col("rank") == k).select("qid", "d").toArrow()
    shared.destroy()
    known = dict(zip(rows["qid"].to_pylist(), rows["d"].to_pylist()))
    return np.array([known.get(q, np.inf) for q in asked.qids.tolist()])


def marked(codes: DataFrame, asked: Questions, reach: np.ndarray, keep: list[str]) -> DataFrame:
    """`keep` columns of the rows whose lower bound is within the reach of some question."""
    shared = codes.sparkSession.sparkContext.broadcast((asked.vectors, reach))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, limits = shared.value
        for batch in batches:
            wins = np.zeros(batch.num_rows, bool)
            if batch.num_rows:
                for r, q, lower, _ in _tiles(batch, points):
                    wins[r : r + _ROWS] |= (lower <= limits[q : q + _LANES, None]).any(axis=0)
            yield batch.select(keep).filter(pa.array(wins))

    source = codes.select(*keep, "code", "scale", "residual")
    return source.mapInArrow(mark, source.select(*keep).schema)


def coded_topk(
    codes: DataFrame,
    vectors: DataFrame,
    questions: DataFrame | Questions,
    k: int = fixed.CANDIDATE_K,
    cell: str | None = None,
    **search,
) -> Coded:
    """The `k` nearest chunks (qid, chunk_id, source_id, d, rank), exactly.

    `codes` is a stored `code_rows` of `vectors`, both with id; `cell` names a partition
    column of both.  Questions beyond the bounds of `gather` take the search over all vectors.
    Without chunks or without questions there are no hits.
    """
    asked = questions if isinstance(questions, Questions) else gather(questions)
    if not asked.small:
        return Coded(nearest(vectors, asked, k, carry="source_id", **search), vectors.count())
    keep = ["id", *([cell] if cell else [])]
    if len(asked.qids) == 0:
        wins = codes.select(*keep).limit(0)
    else:
        # Written: the cells, the count and the search read it.
        wins, _ = stored_at(marked(codes, asked, reaches(codes, asked, k), keep), "marked")
    kept = vectors
    if cell:
        # As many cells as there are lists, at most.
        held = [r[0] for r in wins.select(cell).distinct().collect()]
        kept = kept.filter(F.col(cell).isin(held))
    kept = kept.join(wins.select("id").distinct(), "id", "left_semi")
    return Coded(nearest(kept, asked, k, carry="source_id", **search), wins.count())


def write_codes(indexed: DataFrame, name: str = "codes") -> DataFrame:
    """The codes of `indexed` as a work table, their vectors left out."""
    return stored(code_rows(indexed), name)
