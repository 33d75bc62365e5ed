"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the blocks in which `starts` sums.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it.

    A plain column would be inlined by the optimizer, also into lambdas, and then
    be computed for each element.
    """
    return F.transform(F.array(value), body)[0]


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def indices(size: Column) -> Column:
    """0 .. size - 1; empty for sizes under 1."""
    return F.when(size > 0, F.sequence(F.lit(0), size.cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )


def starts(lengths: Column) -> Column:
    """Sums of all earlier elements of an array of ints, as longs.

    Sums within blocks and then over the blocks: long arrays cost about their
    length times the block length, not its square.
    """

    def by_block(a: Column) -> Column:
        blocks = F.transform(
            indices(F.ceil(F.size(a) / F.lit(BLOCK))), lambda b: F.slice(a, b * BLOCK + 1, BLOCK)
        )

        def total(x: Column) -> Column:
            return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)

        def inside(blocks_: Column) -> Column:
            return let(
                F.transform(blocks_, total),
                lambda sums: F.flatten(
                    F.transform(
                        blocks_,
                        lambda x, b: let(
                            total(F.slice(sums, 1, b)),
                            lambda before: F.transform(
                                x, lambda _, i: before + total(F.slice(x, 1, i))
                            ),
                        ),
                    )
                ),
            )

        return let(blocks, inside)

    return let(lengths, by_block)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, stop, hit), in code points.

    The pattern must not match the empty string.
    """

    def located(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        gaps = F.split(t, pattern, -1)

        def placed(pair: Column) -> Column:
            return let(
                starts(
                    F.zip_with(
                        F.slice(pair["gaps"], 1, F.size(pair["hits"])),
                        pair["hits"],
                        lambda g, h: F.length(g) + F.length(h),
                    )
                ),
                lambda at: F.transform(
                    pair["hits"],
                    lambda h, i: let(
                        at[i] + F.length(pair["gaps"][i]),
                        lambda s: F.struct(
                            s.alias("start"), (s + F.length(h)).alias("stop"), h.alias("hit")
                        ),
                    ),
                ),
            )

        return let(F.struct(hits.alias("hits"), gaps.alias("gaps")), placed)

    none = F.array().cast("array<struct<start:bigint,stop:bigint,hit:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), let(text, located)).otherwise(none)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with more underscores where the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def picked(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, under new names: others may have any name."""
    return docs.select(*(docs[old].alias(new) for new, old in columns.items()))
