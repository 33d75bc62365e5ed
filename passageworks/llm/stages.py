"""Stages of the corpus pipeline: (spark, docs, folder) -> DataFrame.

All but the last return the columns of `documents` and rows of their input: rejected
documents go, one of each near-duplicate class stays, documents that leak a benchmark
item go, and secrets are replaced by a mark.  The last packs what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.llm import leaks, near_copies, packing, quality, secrets
from passageworks.llm.columns import fresh, whole
from passageworks.sources.tables import read_files


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    labels = read_files(spark, f"{folder}/labels.parquet")
    return quality.kept_only(docs, quality.trusted_ids(labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return leaks.without_leaks(docs, read_files(spark, f"{folder}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the spans of the secret scan; `n_chars`, where present, follows."""
    # Equal rows have equal spans: one entry for each (id, text).
    key_name, spans_name = fresh(docs, "_key"), fresh(docs, "_spans")
    found = secrets.scan(docs).where(F.size("spans") > 0).select(
        F.col("text_key").alias(key_name), F.col("spans").alias(spans_name)
    ).dropDuplicates([key_name])
    key = F.xxhash64(docs["doc_id"], docs["text"])
    joined = docs.join(found, key == F.col(key_name), "left")
    text = F.when(F.col(spans_name).isNull(), docs["text"]).otherwise(
        secrets.redacted(whole(docs["text"]), F.col(spans_name))
    )
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col(spans_name).isNull(), docs["n_chars"]).otherwise(F.length(text)).cast(kind)
    return joined.select(*(changed.get(c, docs[c]).alias(c) for c in docs.columns))


def curve_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality-rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret-redaction", secret_redaction),
    ("curve-packing", curve_packing),
]
