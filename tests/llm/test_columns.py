import re

from pyspark.sql import functions as F

from passageworks.llm.columns import indices, matches, starts

TEXTS = ["", "a", "ab 12 ab", "é😀 12 x 345", "12" * 700, " ".join(str(i) for i in range(900))]


def test_matches_are_code_points_as_in_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", matches(F.col("t"), "[0-9]+").alias("m"))
    for row in df.collect():
        want = [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", row.t)]
        assert [tuple(x) for x in row.m] == want


def test_starts_sum_what_is_before(spark):
    values = list(range(1000))
    row = spark.createDataFrame([(values,)], "v array<int>").select(starts(F.col("v")).alias("s")).first()
    assert row.s == [i * (i - 1) // 2 for i in range(1000)]


def test_indices_of_no_size(spark):
    row = spark.range(1).select(indices(F.lit(0)).alias("a"), indices(F.lit(-3)).alias("b"), indices(F.lit(2)).alias("c")).first()
    assert (row.a, row.b, row.c) == ([], [], [0, 1])
