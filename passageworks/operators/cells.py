"""Exact search through cells: radii tell which cells can hold a nearer chunk.

Every cell of the inverted lists has a centre, a radius (its farthest chunk) and a count.
No chunk of a cell is nearer to a question than the distance to the centre less the radius.
A question looks into its cells in the order of that bound; once its k-th distance is under
the bound of the next cell, no other cell can change the result.  All questions of a round
search together, and a round looks into twice as many cells as the one before.

`write_cells` lays a chunk table out by cell once, at indexing; `read_cells` opens that for
any number of searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions import fixed
from passageworks.functions.vectors import TIE_DECIMALS
from passageworks.operators.ivf import fit_centres, read_index, write_index
from passageworks.operators.nearest import Questions, gather, matrix, nearest, ranked
from passageworks.session import remove_work, stored_at

# Rounding of distances, which decides ties, and of the bounds themselves.
_SLACK = 4 * 10.0**-TIE_DECIMALS
# Centres are fitted to a random sample of about this many chunks; all chunks get a cell.
FIT_ROWS = 1_000_000
FIRST_CELLS = 8


@dataclass(frozen=True)
class Cells:
    """Centres of the inverted lists with the radius and the count of each; -1 for an empty one."""

    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray


@dataclass(frozen=True)
class Found:
    """Hits, and in how many of the (question, cell) pairs they were looked for."""

    hits: DataFrame
    probed: int
    rounds: int


@dataclass(frozen=True)
class CellIndex:
    """A chunk table by cell (id, source_id, embedding, cell) with its measured cells.

    `first` is the number of cells of the first round of an exact search.  With `probes`,
    a search looks into that many cells only, and is approximate.
    """

    chunks: DataFrame
    cells: Cells
    first: int = FIRST_CELLS
    probes: int | None = None


def write_cells(
    chunks: DataFrame, path: str, lists: int = fixed.INDEX_LISTS, fit_rows: int | None = FIT_ROWS
) -> None:
    """Lay chunks (id, source_id, embedding) out by cell under `path`, and measure the cells.

    Contents are left out.  The centres are written last, one row per cell.
    """
    spark = chunks.sparkSession
    placed = chunks.select("id", "source_id", "embedding")
    centres = fit_centres(placed, lists, fit_rows=fit_rows)
    write_index(placed, centres, f"{path}/chunks")
    cells = measure_cells(read_index(spark, f"{path}/chunks"), centres)
    rows = zip(range(len(centres)), centres.tolist(), cells.radius.tolist(), cells.count.tolist())
    schema = "cell int, centre array<double>, radius double, n long"
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def read_cells(
    spark: SparkSession, path: str, first: int = FIRST_CELLS, probes: int | None = None
) -> CellIndex:
    """What `write_cells` left at `path`; one row per cell reaches the driver."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
    measured = Cells(matrix(rows["centre"]), rows["radius"].to_numpy(), rows["n"].to_numpy())
    return CellIndex(read_index(spark, f"{path}/chunks"), measured, first, probes)


def measure_cells(indexed: DataFrame, centres: np.ndarray, vector: str = "embedding") -> Cells:
    """Radius and count of each cell, in one pass over chunks with their `cell`.

    A task sends one row for each of its cells, and at most one row per cell reaches the driver.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, count = np.full(len(centres), -1.0), np.zeros(len(centres), np.int64)
        for batch in batches:
            if batch.num_rows:
                cell = batch.column("cell").to_numpy()
                diff = matrix(batch.column(vector)).astype(np.float64) - centres[cell]
                np.maximum.at(far, cell, np.sqrt(np.einsum("ij,ij->i", diff, diff)))
                count += np.bincount(cell, minlength=len(centres))
        held = np.flatnonzero(count)
        columns = [pa.array(held.astype(np.int32)), pa.array(far[held]), pa.array(count[held])]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "radius", "n"])

    parts = indexed.select("cell", vector).mapInArrow(measure, "cell int, radius double, n long")
    rows = parts.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).toArrow()
    radius, count = np.full(len(centres), -1.0), np.zeros(len(centres), np.int64)
    radius[rows["cell"].to_numpy()] = rows["radius"].to_numpy()
    count[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return Cells(centres, radius, count)


def next_cells(cells: Cells, start: int, stop: int):
    """Arrow UDF: of a vector's cells, by bound and then by centre, those from place `start` to
    `stop` that can hold a chunk within its distance `reach`."""
    full = np.flatnonzero(cells.count)

    @F.arrow_udf("array<int>")
    def wanted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        centres, radius = cells.centres[full], cells.radius[full]
        for vectors, reach in batches:
            out: list[list[int]] = []
            if len(vectors) and len(full):
                points = matrix(vectors).astype(np.float64)
                for p, r in zip(points, reach.to_numpy(zero_copy_only=False)):
                    diff = centres - p
                    to_centre = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                    bound = np.maximum(to_centre - radius, 0.0)
                    near = np.lexsort((to_centre, bound))[start:stop]
                    out.append(full[near[bound[near] <= r + _SLACK]].tolist())
            else:
                out = [[] for _ in range(len(vectors))]
            yield pa.array(out, pa.list_(pa.int32()))

    return wanted


def bounded_topk(
    indexed: DataFrame,
    questions: DataFrame | Questions,
    cells: Cells,
    k: int = fixed.CANDIDATE_K,
    first: int = 1,
    **search,
) -> Found:
    """The `k` nearest chunks (qid, chunk_id, source_id, d, rank), exactly.

    `indexed` has a `cell` column, best as its partition column, so that other cells are not
    read.  Results of the rounds are work tables; the last one is returned.
    """
    spark = indexed.sparkSession
    asked = questions if isinstance(questions, Questions) else gather(questions)
    best, best_path, probed, rounds, start, width = None, None, 0, 0, 0, first
    lists = int(np.count_nonzero(cells.count))
    empty = "qid long, chunk_id long, source_id long, d double, rank int"
    while start < lists:
        reach, kth = F.lit(float("inf")), None
        frame = asked.frame.select("qid", "embedding", reach.alias("reach"))
        if best is not None:
            kth = best.filter(F.col("rank") == k).select("qid", F.col("d").alias("kth"))
            frame = asked.frame.join(kth, "qid", "left").select(
                "qid", "embedding", F.coalesce("kth", reach).alias("reach")
            )
        wanted = next_cells(cells, start, start + width)(F.col("embedding"), F.col("reach"))
        routes, routes_path = stored_at(frame.select("qid", F.explode(wanted).alias("cell")), "routes")
        n = routes.count()
        if n:
            found = nearest(
                indexed, asked, k, carry="source_id", group="cell", routes=routes,
                within=None if kth is None else kth.withColumnRenamed("kth", "reach"), **search
            ).drop("rank")
            if best is not None:
                found = found.unionByName(best.drop("rank"))
            newer, newer_path = stored_at(ranked(found, ["qid"], k), "nearest")
            if best_path is not None:
                remove_work(spark, best_path)
            best, best_path, probed, rounds = newer, newer_path, probed + n, rounds + 1
        remove_work(spark, routes_path)
        if not n:
            break
        start, width = start + width, 2 * width
    return Found(spark.createDataFrame([], empty) if best is None else best, probed, rounds)
