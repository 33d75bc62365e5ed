"""Approximate search through inverted lists (cells around k-means centres)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions import fixed
from passageworks.operators.nearest import Questions, matrix, nearest

def fit_centres(
    chunks: DataFrame,
    lists: int = fixed.INDEX_LISTS,
    vector: str = "embedding",
    seed: int = 1,
    fit_rows: int | None = None,
) -> np.ndarray:
    """At most `lists` centres (lists × dim) by distributed k-means.

    All rows count, or a random sample of about `fit_rows` of them if that is given;
    every row is assigned to a cell in either case.
    """
    rows = chunks.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if fit_rows is not None and (total := rows.count()) > fit_rows:
        rows = rows.sample(fit_rows / total, seed=seed)
    model = KMeans(k=lists, seed=seed, maxIter=10, initMode="k-means||").fit(rows)
    return np.array(model.clusterCenters())


def nearest_cells(centres: np.ndarray, probes: int):
    """Arrow UDF: the `probes` nearest cells of a vector, nearest first."""
    norms = np.einsum("ij,ij->i", centres, centres)
    probes = min(probes, len(centres))

    @F.arrow_udf("array<int>")
    def cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            n = len(vectors)
            order = np.zeros((0, probes), np.int32)
            if n:
                far = norms[None, :] - 2.0 * (matrix(vectors).astype(np.float64) @ centres.T)
                order = np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)
            offsets = np.arange(0, (n + 1) * probes, probes, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.reshape(-1)))

    return cells


def assign_cells(chunks: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """chunks + cell, the nearest centre."""
    return chunks.withColumn("cell", nearest_cells(centres, 1)(F.col(vector))[0])


def write_index(
    chunks: DataFrame,
    centres: np.ndarray,
    path: str,
    vector: str = "embedding",
) -> None:
    """Store chunks by cell, so that a search reads the probed cells only.

    Rebalancing lets adaptive execution split a very full cell over several
    tasks and merge small ones.
    """
    placed = assign_cells(chunks, centres, vector).hint("rebalance", "cell")
    placed.write.mode("overwrite").partitionBy("cell").parquet(path)


@dataclass(frozen=True)
class Lists:
    """Centres of the inverted lists, and how many of them a search looks into."""

    centres: np.ndarray
    probes: int


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ann_topk(
    indexed: DataFrame,
    questions: DataFrame | Questions,
    centres: np.ndarray,
    nprobe: int,
    k: int = fixed.CANDIDATE_K,
    **search,
) -> DataFrame:
    """(qid, chunk_id, source_id, d, rank) within the `nprobe` nearest cells.

    With as many probes as cells the result equals the exact search.
    """
    # The outer form spares an inferred size filter, hence a second UDF call.
    asked = questions.frame if isinstance(questions, Questions) else questions
    probed = asked.select(
        "qid", F.explode_outer(nearest_cells(centres, nprobe)(F.col("embedding"))).alias("cell")
    )
    return nearest(
        indexed, questions, k, carry="source_id", group="cell", routes=probed, **search
    )
