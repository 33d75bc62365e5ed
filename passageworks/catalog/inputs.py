"""Test tables in the roles of the pipeline's tables.

Every role uses its whole table.  `oracles` states the same mappings in SQL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.tokens import Cuts, Running, batch_counter, counted_by_cuts
from passageworks.session import ship_package
from passageworks.sources.tables import read_files, spread

# Words that occur in the test documents, in about a fifth of their lines.
TOPICS = {
    "Deutsch": ["schlich", "keit"],
    "English": ["thwh"],
    "Français": ["queau", "ouelle"],
    "Licence": ["license"],
}
CHUNK_TOKENS = 40

_TOKEN = re.compile(r"\w+|[^\w \t\n\r\f\v]")


def _tokens(texts: Sequence[str]) -> list[int]:
    return [len(_TOKEN.findall(t)) for t in texts]


def _pairs(tokens: int) -> int:
    return (tokens + 1) // 2


def _paired(texts: Sequence[str]) -> list[int]:
    return [_pairs(n) for n in _tokens(texts)]


_CUTS = Cuts(_tokens, r"\s", _pairs)


def _running_paired() -> Running:
    add = counted_by_cuts(_CUTS.count, _CUTS.cut)
    return lambda piece: _CUTS.total(add(piece))


# Tokens merge two by two from the left: counts of parts do not add up.
PAIRED = batch_counter(_paired, running=_running_paired, cuts=_CUTS)


class Inputs:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        ship_package(spark)

    def table(self, name: str) -> DataFrame:
        return read_files(self.spark, f"{self.path}/{name}.parquet")

    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower("c_mktsegment"), F.lit("@example.org")).alias("email"),
            F.lit("customer").alias("role"),
        )

    def tickets(self) -> DataFrame:
        open_ = F.col("o_orderstatus") == "O"
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
            F.when(F.col("o_totalprice") > 250000, "large").otherwise("small").alias("category"),
            F.col("o_orderdate").alias("created_at"),
            F.when(~open_, F.col("o_orderdate")).alias("closed_at"),
        )

    def messages(self) -> DataFrame:
        return self.table("lineitem").select(
            (
                (F.col("l_partkey") * 10_000_000 + F.col("l_suppkey")) * 10
                + F.col("l_linenumber")
            ).alias("id"),
            F.col("l_orderkey").alias("ticket_id"),
            F.col("l_returnflag").alias("sender_type"),
            F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("sender_name"),
            F.concat(
                F.lit("part "),
                F.col("l_partkey").cast("string"),
                F.lit(" line "),
                F.col("l_linenumber").cast("string"),
                F.lit(" "),
                F.col("l_linestatus"),
            ).alias("body"),
            F.col("l_shipdate").alias("created_at"),
        )

    def turns(self) -> DataFrame:
        """Conversation turns with their line, `[role] text`."""
        return self.table("conversations").select(
            "conv_id",
            "turn",
            "role",
            "text",
            (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"),
            F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text")).alias("line"),
        )

    def user_turns(self) -> DataFrame:
        return self.turns().filter("role = 'user'")

    def documents(self) -> DataFrame:
        """(doc_id, text), every line a paragraph of its own."""
        return spread(
            self.table("documents").select(
                "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")
            )
        )

    def document_paragraphs(self) -> DataFrame:
        """(doc_id, paragraph), a document being one paragraph."""
        return spread(
            self.table("documents").select("doc_id", F.col("text").alias("paragraph"))
        )

    def vector_chunks(self) -> DataFrame:
        """(id, source_id, embedding); chunks of label 0 have no source."""
        return spread(
            self.table("embeddings").select(
                F.col("vec_id").alias("id"),
                F.nullif(F.col("label"), F.lit(0)).cast("long").alias("source_id"),
                "embedding",
            )
        )

    def vector_questions(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("qid"), "embedding")

    def document_chunks(self) -> DataFrame:
        """(id, source_id, content): documents as chunks of their source."""
        return spread(
            self.table("documents").select(
                F.col("doc_id").alias("id"),
                F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("source_id"),
                F.col("text").alias("content"),
            )
        )
