"""Quality rules: word rules and a hashed n-gram likelihood ratio.

A document is kept when it passes the word rules and when the mean, over its words
and word pairs, of log(p_trusted / p_corpus) reaches a threshold.  Both are
multinomials over hash buckets: the corpus' counts every document, the trusted one those
of a trusted set of ids.  Both are smoothed at the scale of the trusted counts, so that
buckets too rare to tell weigh nothing, also in small tables.

The bucket count does not depend on the data, so the weights are one array of
`buckets` doubles, which the tasks get as a constant of the plan.

Defined cases: a null text has no words and fails the rules; without trusted
documents every ratio is 0; null and repeated trusted ids count once or not at all;
windows are compared by 64-bit keys;
documents that repeat an id are judged each by its own text, and all count for the
multinomials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.llm.columns import fresh, indices, let, picked, whole

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
BUCKETS = 1 << 16
#: Added to a bucket's trusted count and to the count its corpus share predicts.
SMOOTHING = 10.0
#: Weights are kept in such parts of one.
UNITS = 1000
#: Mean log ratio below which a document is unlike the trusted ones.
THRESHOLD = -0.15
#: Most rows that the trusted multinomial is fitted on, about; their ids are broadcast.
TRUSTED_ROWS = 1 << 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(whole(text), SPACE, -1), "")


def window_keys(hashes: Column, window: int = WINDOW) -> Column:
    """64-bit keys of all windows of that many words, a power of two, by doubling."""

    def doubled(keys: Column, step: int) -> Column:
        return let(
            keys,
            lambda k: F.transform(
                indices(F.size(k) - step), lambda i: F.xxhash64(k[i], k[i + step])
            ),
        )

    step = 1
    while step < window:
        hashes, step = doubled(hashes, step), 2 * step
    return hashes


def repeated_words(keys: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows whose key occurs twice or more in the array."""

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(
                places,
                lambda p, i: F.when(i == 0, F.lit(window)).otherwise(
                    F.least(F.lit(window), p - F.get(places, i - 1))
                ),
            ),
            F.lit(0).cast("long"),
            lambda s, v: s + v,
        )

    ordered = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = let(
        ordered,
        lambda o: F.sort_array(
            F.transform(
                F.filter(
                    o,
                    lambda x, j: F.coalesce(F.get(o, j - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get(o, j + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    # The cheap test is enough for most texts.
    return F.when(
        F.size(F.array_distinct(keys)) < F.size(keys), let(repeated, covered)
    ).otherwise(F.lit(0).cast("long"))


def features(hashes: Column, buckets: int) -> Column:
    """Bucket numbers of the words and of the neighbouring pairs."""
    return let(
        hashes,
        lambda h: F.concat(
            F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int")),
            F.transform(
                indices(F.size(h) - 1),
                lambda i: F.pmod(F.xxhash64(h[i], h[i + 1]), F.lit(buckets)).cast("int"),
            ),
        ),
    )


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of trusted rows of (doc_id, quality): all, or about `rows` of them by hash."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    share = min(1.0, rows / max(1, good.count()))
    slots = 1 << 31
    return good.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < F.lit(int(share * slots)))


def weights(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING
) -> DataFrame:
    """One row: `weights`, log(p_trusted / p_corpus) of each bucket.

    `docs` has doc_id and text; `trusted` has few enough doc_ids to broadcast
    (`trusted_ids` bounds them).
    """
    flagged = docs.join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("flag"))), "doc_id", "left"
    )
    counts = (
        flagged.select(
            F.explode(features(word_hashes(F.col("text")), buckets)).alias("bucket"), "flag"
        )
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("corpus"), F.count("flag").alias("trusted"))
    )
    spark = docs.sparkSession
    dense = (
        spark.range(buckets)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(counts, "bucket", "left")
        .fillna(0, ["corpus", "trusted"])
        .agg(
            F.array_sort(F.collect_list(F.struct("bucket", "corpus", "trusted"))).alias("all"),
            F.sum("corpus").alias("n_corpus"),
            F.sum("trusted").alias("n_trusted"),
        )
    )
    share = F.col("n_trusted") / F.greatest("n_corpus", F.lit(1))
    return dense.select(
        F.transform(
            "all",
            lambda x: F.log((x["trusted"] + smoothing) / (x["corpus"] * share + smoothing)),
        ).alias("weights")
    )


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    carry: str | None = None,
) -> DataFrame:
    """Per row of `docs`: the word counts, `ratio`, `base_failed` and `kept`.

    A column named by `carry` is handed on beside them.
    """
    own = picked(docs, doc_id=id_col, text=text_col)
    more = [] if carry is None else [carry]
    rows_of = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *more)
    # Folded to one array constant; subqueries can't stand inside lambdas.  Plans print
    # it, so it holds short integers.
    units = F.transform("weights", lambda w: F.round(w * UNITS).cast("int"))
    fitted = weights(own, trusted, buckets).select(F.concat_ws(",", units.cast("array<string>")))
    model = F.split(F.lit(fitted.first()[0]), ",").cast("array<int>")
    text = whole(F.col("text"))
    hashes = word_hashes(F.col("text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    measured = let(
        hashes,
        lambda h: F.struct(
            F.size(h).cast("long").alias("n_words"),
            window_keys(h).alias("windows"),
            let(
                features(h, buckets),
                lambda f: F.aggregate(f, F.lit(0).cast("long"), lambda s, b: s + model[b])
                / (F.greatest(F.size(f), F.lit(1)) * UNITS),
            ).alias("ratio"),
        ),
    )
    rows = rows_of.select(
        "doc_id", *more,
        measured.alias("m"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).withColumn("n_repeat_words", repeated_words(F.col("m.windows")))
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED
    )
    return (
        rows.select(
            "doc_id", *more, "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "m.ratio"
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
    )


def kept_only(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that `judge` keeps: judged where they lie."""
    whole_row = F.struct(*(docs[c] for c in docs.columns))
    row = fresh(docs, "_row")
    judged = judge(docs.withColumn(row, whole_row), trusted, id_col=id_col, text_col=text_col, carry=row)
    return judged.where("kept").select(*(F.col(row).getField(c).alias(c) for c in docs.columns))
