"""Two-stage retrieval: candidates, group scores, chunks inside the best groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passageworks.functions import fixed
from passageworks.functions.vectors import TIE_DECIMALS, score
from passageworks.operators.cells import CellIndex, bounded_topk
from passageworks.operators.ivf import Lists, ann_topk
from passageworks.operators.nearest import MAX_QUESTIONS, Questions, gather, nearest
from passageworks.session import stored


def candidates(
    chunks: DataFrame,
    questions: DataFrame | Questions,
    candidate_k: int = fixed.CANDIDATE_K,
    index: Lists | CellIndex | None = None,
    **search,
) -> DataFrame:
    """(qid, chunk_id, source_id, d, score, rank): nearest chunks of any source.

    A chunk without a source takes its place among the nearest.  With `Lists` as `index`,
    `chunks` are those that `ivf.read_index` gives, and only the nearest lists are read.  With a
    `CellIndex`, the chunks of that are searched: exactly, unless it limits the probes.
    """
    if index is None:
        hits = nearest(chunks, questions, candidate_k, carry="source_id", **search)
    elif isinstance(index, CellIndex):
        if index.probes is None:
            hits = bounded_topk(index.chunks, questions, index.cells, candidate_k, index.first, **search).hits
        else:
            hits = ann_topk(index.chunks, questions, index.cells.centres, index.probes, candidate_k, **search)
    else:
        hits = ann_topk(chunks, questions, index.centres, index.probes, candidate_k, **search)
    return hits.select(
        "qid", "chunk_id", "source_id", "d", score(F.col("d")).alias("score"), "rank"
    )


def with_content(hits: DataFrame, chunks: DataFrame, chunk_id: str = "id") -> DataFrame:
    """Add the content of the hit chunks.  The search itself never reads it; hits
    proven few are broadcast, so that the contents are not shuffled."""
    contents = chunks.select(F.col(chunk_id).cast("long").alias("chunk_id"), "content")
    return contents.join(hits, "chunk_id")


def group_scores(hits: DataFrame) -> DataFrame:
    """(qid, source_id, score, best_rank, group_rank): summed scores per source.

    Hits without a source are dropped here, after the nearest were chosen.
    Equal sums rank by the best hit.
    """
    sums = (
        hits.filter(F.col("source_id").isNotNull())
        .groupBy("qid", "source_id")
        .agg(F.sum("score").alias("score"), F.min("rank").alias("best_rank"))
    )
    order = W.partitionBy("qid").orderBy(F.round("score", TIE_DECIMALS).desc(), "best_rank")
    return sums.withColumn("group_rank", F.row_number().over(order))


def top_groups(hits: DataFrame, n: int = fixed.TOP_GROUPS) -> DataFrame:
    return group_scores(hits).filter(F.col("group_rank") <= n)


def group_chunks(
    chunks: DataFrame,
    questions: DataFrame | Questions,
    groups: DataFrame,
    top_k: int = fixed.TOP_K,
    **search,
) -> DataFrame:
    """(qid, source_id, group_rank, group_score, chunk_id, d, score, rank).

    The nearest `top_k` chunks inside each chosen group, out of all its chunks
    and not only the candidates.
    """
    routes = groups.select(
        "qid",
        F.col("source_id").cast("long"),
        "group_rank",
        F.col("score").alias("group_score"),
    )
    hits = nearest(
        chunks, questions, top_k, group="source_id", routes=routes, per_group=True, **search
    )
    return hits.withColumn("score", score(F.col("d")))


def lateral_chunks(chunks: DataFrame, asked: DataFrame, top_k: int = fixed.TOP_K) -> DataFrame:
    """(qid, source_id, chunk_id, d, rank): for each (qid, source_id, embedding) the nearest
    `top_k` chunks of that source, as a correlated subquery with order and limit.

    Which chunks can be among them is found first, by matrix products within each source
    (`nearest`), and written: at most `top_k` short rows for each row of `asked`, where a join
    would make a row of every pair.  The lookup itself is equi-joins and a limited
    window over those.  A vector that is NULL or holds NULLs has no distance, which comes first.
    """
    # Questions may repeat: each row is looked up by a number of its own.
    points = stored(
        asked.filter("qid IS NOT NULL AND source_id IS NOT NULL").select(
            F.monotonically_increasing_id().alias("point"),
            "qid", F.col("source_id").cast("long").alias("source_id"), "embedding",
        ),
        "points",
    )
    rows = chunks.filter("source_id IS NOT NULL").select(
        F.col("id").cast("long").alias("id"), F.col("source_id").cast("long").alias("source_id"), "embedding"
    )
    known = F.coalesce(~F.exists("embedding", lambda x: x.isNull()), F.lit(False))
    routes = points.filter(known).select(
        F.col("point").alias("qid"), "source_id", F.col("qid").alias("of")
    )
    near = nearest(
        rows.filter(known), points.filter(known).select(F.col("point").alias("qid"), "embedding"),
        top_k, group="source_id", routes=routes, per_group=True,
    ).select("of", F.col("source_id").alias("own"), "chunk_id", "d")
    hits = near.unionByName(_without_distance(rows, points, known, top_k))
    inner = stored(hits, "lookup")
    outer = asked.select("qid", F.col("source_id").cast("long").alias("source_id"))
    nearest_rows = (
        inner.filter((F.col("of") == F.col("qid").outer()) & (F.col("own") == F.col("source_id").outer()))
        .select("chunk_id", "d")
        .orderBy("d", "chunk_id")
        .limit(top_k)
    )
    order = W.partitionBy("qid", "source_id").orderBy("d", "chunk_id")
    return outer.lateralJoin(nearest_rows).select(
        "qid", "source_id", "chunk_id", "d", F.row_number().over(order).alias("rank")
    )


def _without_distance(rows: DataFrame, points: DataFrame, known: Column, top_k: int) -> DataFrame:
    """(of, own, chunk_id, d): the first `top_k` chunks whose distance to a point is NULL."""
    order = W.partitionBy("source_id").orderBy("id")

    def first(some: DataFrame) -> DataFrame:
        placed = some.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top_k)
        return placed.select("source_id", F.col("id").alias("chunk_id"))

    void = first(rows.filter(~known)).join(points.filter(known), "source_id")
    any_chunk = first(rows).join(points.filter(~known), "source_id")
    return void.unionByName(any_chunk).select(
        F.col("qid").alias("of"), F.col("source_id").alias("own"), "chunk_id", F.lit(None).cast("double").alias("d")
    )


def retrieve(
    chunks: DataFrame,
    questions: DataFrame,
    candidate_k: int = fixed.CANDIDATE_K,
    groups: int = fixed.TOP_GROUPS,
    top_k: int = fixed.TOP_K,
    max_questions: int = MAX_QUESTIONS,
    index: Lists | CellIndex | None = None,
    **search,
) -> DataFrame:
    """Both stages.  The first runs when this is called, because its winners
    route the second; only the winners come back to the driver, and only when
    the question table is within the broadcast bound."""
    asked = gather(questions, max_questions)
    best = top_groups(candidates(chunks, asked, candidate_k, index, **search), groups)
    return group_chunks(chunks, asked, best, top_k, **search)
