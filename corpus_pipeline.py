"""The corpus pipeline: quality rules, near-duplicates, leaks, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passageworks.llm import stages
from passageworks.session import stored

STAGES = stages.STAGES
#: Alignment, tiling and tokenizing have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's documents are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
