"""The registered queries of this subpackage: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.llm import archives, leaks, lexical, licenses, near_copies, packing, quality, secrets, spelling, suffixes
from passageworks.llm import token_counts as counts
from passageworks.llm import toxicity, wrappers
from passageworks.llm.oracles import ORACLES
from passageworks.sources.tables import read_files

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_files(spark, f"{folder}/{name}.parquet")


def secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, folder, "documents")))


def near_copy_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies.classes(_table(spark, folder, "documents"))


def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents")).drop("detections")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    labels = _table(spark, folder, "labels")
    return quality.judge(_table(spark, folder, "documents"), quality.trusted_ids(labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "ratio",
    )


def warc_packages(spark: SparkSession, folder: str) -> DataFrame:
    return archives.round_trip(_table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def page_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(_table(spark, folder, "pages"))


def repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.deduplicate(_table(spark, folder, "documents"), with_text=False)


def toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = toxicity.score(
        _table(spark, folder, "documents"), _table(spark, folder, "labels"), held_out=held_out
    )
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= toxicity.PREDICT_FROM).cast("int").alias("predicted"), "n_tokens",
        F.size("passages").cast("long").alias("n_passages"),
    )


def curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_table(spark, folder, "documents"), path, with_ids=False)


def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return counts.count_tokens(_table(spark, folder, "documents"), path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_ownership": secret_ownership,
    "op2_near_copies": near_copy_classes,
    "op3_license_rules": license_rules,
    "op4_benchmark_leaks": benchmark_leaks,
    "op5_page_wrappers": page_wrappers,
    "op6_repeated_strings": repeated_strings,
    "op7_toxic_segments": toxic_segments,
    "op8_curve_packing": curve_packing,
    "op9_quality_rules": quality_rules,
    "op10_warc_packages": warc_packages,
    "op11_spelling_variants": spelling_variants,
    "op12_lexical_search": lexical_search,
    "op13_token_counts": token_counts,
}
