"""Connected components by alternating star contraction, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.session import remove_work, work_path


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes but the roots, from links (a, b) between long ids.

    The root is the component's smallest id.  A round joins every node's links to its
    smallest neighbour, first those to larger nodes and then those to smaller ones;
    rounds go on until nothing changes.  Each is written to a work table of its own,
    so a lost executor costs a round at most.
    """
    spark = links.sparkSession
    edges, path = _written(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    seen = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(least, "hi").where("lo > hi and lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large.distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new, new_path = _written(moved.unionByName(least.withColumnRenamed("m", "lo")).distinct())
        now = _mark(new)
        remove_work(spark, path)
        edges, path = new, new_path
        if now == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = now


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = work_path(df.sparkSession, "stars")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    )
