"""Key constraints by bit tables: one bit for each possible integer key.

Keys of both tables become bits of buckets, combined where they are read, so that a key costs
a bit in the shuffle and not a row.  A bucket in which the child's bits add to the parent's
has an orphan; only rows of such buckets go on to the join that counts them.  As many bits as
rows mean that a key is unique.  The bits are the keys themselves, not hashes, so nothing is
missed and clean keys never reach a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.operators.quality import foreign_check, key_check, row_checks
from passageworks.sources.schemas import TableSpec

# Bits that a key may cost on average; sparser keys are checked by the ordinary join.
MAX_BITS_PER_KEY = 256
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def bit_table(df: DataFrame, column: str) -> DataFrame:
    """(bucket, bits) of the non-null keys."""
    key = F.col(column).cast("long")
    return (
        df.filter(F.col(column).isNotNull())
        .select(F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("at"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
    )


def dense_keys(df: DataFrame, column: str) -> bool:
    """Whether integer keys lie close enough together for a bit table; from one aggregate."""
    if dict(df.dtypes)[column] not in INTEGERS:
        return False
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    return n == 0 or (hi - lo + 1) <= MAX_BITS_PER_KEY * n


def suspect_buckets(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(bucket): those in which a child key is no parent key."""
    own = bit_table(parent, key).select("bucket", F.col("bits").alias("own"), F.lit(None).cast("binary").alias("other"))
    other = bit_table(child, column).select("bucket", F.lit(None).cast("binary").alias("own"), F.col("bits").alias("other"))
    return (
        own.unionByName(other)
        .groupBy("bucket")
        .agg(F.bitmap_or_agg(F.coalesce("own", "other")).alias("all"), F.bitmap_or_agg("own").alias("known"))
        .filter(F.bitmap_count("all") > F.coalesce(F.bitmap_count("known"), F.lit(0)))
        .select("bucket")
    )


def suspects(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of `child` whose keys share a bucket with an orphan key."""
    rows = child.filter(F.col(column).isNotNull()).select(column)
    bucket = F.bitmap_bucket_number(F.col(column).cast("long"))
    found = suspect_buckets(child, column, parent, key)
    return rows.join(found, bucket == F.col("bucket"), "left_semi")


def check_table_bits(
    df: DataFrame, spec: TableSpec, parents: dict[str, tuple[DataFrame, str]] | None = None
) -> DataFrame:
    """As `quality.check_table`, with keys checked by bit tables where they are dense integers."""
    parents = parents or {}
    parts = [row_checks(df, spec)]
    if len(spec.primary_key) == 1 and dense_keys(df, spec.primary_key[0]):
        parts.append(_unique(df, spec.primary_key[0]))
    else:
        parts.append(key_check(df, spec.primary_key))
    for column in spec.foreign_keys:
        if column not in parents:
            continue
        parent, key = parents[column]
        child = df
        if dense_keys(df, column) and dense_keys(parent, key):
            child = suspects(df, column, parent, key)
        parts.append(foreign_check(child, column, parent, key))
    return reduce(DataFrame.unionByName, parts)


def _unique(df: DataFrame, column: str) -> DataFrame:
    """Surplus rows: all rows less different keys, null being a key as in the grouping."""
    rows = df.agg(F.count("*").alias("rows"), F.max(F.col(column).isNull().cast("long")).alias("nulls"))
    bits = bit_table(df, column).agg(F.sum(F.bitmap_count(F.col("bits"))).alias("keys"))
    n_bad: Column = F.col("rows") - F.coalesce("keys", F.lit(0)) - F.coalesce("nulls", F.lit(0))
    # Two tables of one row each.
    both = rows.select("rows", "nulls", F.lit(0).alias("one")).join(bits.select("keys", F.lit(0).alias("one")), "one")
    return both.select(F.lit("unique").alias("check"), F.lit(column).alias("column"), n_bad.cast("long").alias("n_bad"))
