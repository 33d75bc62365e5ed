"""Toxic passages: maximum-scoring segments over token log-odds.

Training counts words in toxic and in clean documents by their distinct left
neighbours, so that copies of a document add nothing, and prefixes of words by the
distinct words that carry them.  Weights are log-odds under Dirichlet priors, moved
towards zero by `CAUTION` standard errors.  A token has the weight of its word if that
is known, else of its longest known prefix, less a small drift.

A linear-time scan finds all maximal-scoring segments of a document (Ruzzo and Tompa).
The number of segments that reach a score by chance in n tokens is K n exp(-lambda S),
with lambda and K from clean training documents; a document's evidence is the sum of
log(1 / that number) over the segments below one.  A logistic curve, fitted on the training
documents, turns the evidence into the score.

The classifier is fitted on a sample of the labelled rows, `TRAIN_ROWS` of them at
most (about), which bounds what is broadcast: the words and prefixes of these rows whose
weight is not that of their longest shorter prefix.  No other unit changes a score.  One
function splits texts for fitting and for scoring.  Every document is scored whole.

Defined cases: null and empty texts have no token and get the score of no evidence;
ids with contradicting labels count as toxic; null ids or labels train nothing; without
toxic or without clean training rows every score is 0; rows that repeat an id are
scored each by its own text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.llm.batches import slices
from passageworks.llm.columns import picked, whole
from passageworks.session import ship_package, stored

TRAIN_ROWS = 50_000
PREFIXES = (3, 4, 5, 6)
PRIOR, CAUTION, DRIFT = 1.0, 1.65, 0.3
#: Counts from which words, and distinct words from which prefixes, are known.
MIN_SEEN, MIN_STEM = 3, 10
MAX_LAMBDA = 3.0
PREDICT_FROM = 0.7
WORK_BYTES = 4 << 20
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Weights of words and of prefixes (marked `^`), and the calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    rate: float = MAX_LAMBDA
    k: float = 1.0
    slope: float = 0.0
    intercept: float = -math.inf

    def stem(self, word: str) -> float:
        """Weight of the word's longest known prefix, 0 without one."""
        for n in reversed(PREFIXES):
            if len(word) >= n:
                found = self.weights.get("^" + word[:n])
                if found is not None:
                    return found
        return 0.0

    def learn(self, unit: str, weight: float) -> None:
        """Keep a unit's weight unless it has it anyway; shorter prefixes come before longer
        ones, and prefixes before words."""
        if weight != self.stem(unit.removeprefix("^")):
            self.weights[unit] = weight

    def token(self, word: str) -> float:
        found = self.weights.get(word)
        return (self.stem(word) if found is None else found) - DRIFT


class Memo(dict):
    """Token -> weight, remembered up to a number of tokens."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = self.model.token(word)
        return found


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, stop, score), in linear time."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[list] = []  # first, stop, sum before, sum behind, the kept one to look at next
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, sums[i], sums[i + 1], -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, float(r - l)) for a, b, l, r, _ in kept]


def evidence(model: Model, segments: list[tuple[int, int, float]], n: int) -> float:
    limit = math.log(max(model.k * n, 1e-300)) if n else 0.0
    return sum(max(0.0, model.rate * s - limit) for _, _, s in segments)


def probability(model: Model, found: float) -> float:
    if model.intercept == -math.inf:
        return 0.0
    return 1.0 / (1.0 + math.exp(-(model.intercept + model.slope * math.log1p(found))))


def log_odds(counts: DataFrame, least: int) -> DataFrame:
    """(unit, weight) of rows (unit, toxic, clean) by their shares of all counts.

    Units with fewer counts than `least` are left out; they count for the shares only
    where one of the classes has no others.
    """
    known = F.col("toxic") + F.col("clean") >= least
    sums = [F.sum(F.when(w, F.col(c))) for w in (known, F.lit(True)) for c in ("toxic", "clean")]
    found = [float(x or 0) for x in counts.agg(*sums).first()]
    n1, n0 = found[:2] if all(found[:2]) else found[2:]
    if not n1 or not n0:
        return counts.select("unit", F.lit(0.0).alias("weight")).limit(0)
    a1, a0 = PRIOR * n1 / (n1 + n0), PRIOR * n0 / (n1 + n0)
    y1, y0 = F.col("toxic") + a1, F.col("clean") + a0
    odds = F.log(y1 / (n1 + PRIOR - y1)) - F.log(y0 / (n0 + PRIOR - y0))
    error = F.sqrt(1 / y1 + 1 / y0)
    weight = F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - CAUTION * error)
    return counts.where(known).select("unit", weight.alias("weight"))


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int) -> DataFrame:
    """(text, toxic) of about `rows` labelled documents at most, by hash of the id; stored."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, rows / max(1, usable.count()))
    slots = 1 << 31
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < F.lit(int(share * slots)))
    # `chosen` is bounded by `rows`.
    return stored(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-train")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, left, seen) of training rows; `seen` has bit 1 for toxic and bit 2 for clean ones."""
    for batch in slices(batches, "text", WORK_BYTES):
        seen: dict[tuple[str, str], int] = {}
        for text, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic"))):
            found = words(text or "")
            bit = 1 if toxic else 2
            for pair in set(zip(found, ["", *found])):
                seen[pair] = seen.get(pair, 0) | bit
        units, lefts = zip(*seen) if seen else ((), ())
        columns = [pa.array(units, pa.string()), pa.array(lefts, pa.string()), pa.array(seen.values(), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["unit", "left", "seen"])


def learn_units(model: Model, train: DataFrame) -> None:
    """Give the model the weights of the training rows' words and prefixes."""
    pairs = (
        train.mapInArrow(_pairs, "unit string, left string, seen int")
        .groupBy("unit", "left").agg(F.bit_or("seen").alias("seen"))
    )
    counts = pairs.groupBy("unit").agg(
        F.count_if(F.col("seen").bitwiseAND(1) > 0).alias("toxic"),
        F.count_if(F.col("seen").bitwiseAND(2) > 0).alias("clean"),
    )
    counts = stored(counts, "toxic-words")
    prefixes = (
        counts.select(
            F.explode(F.array(*(F.substring("unit", 1, n) for n in PREFIXES))).alias("prefix"),
            "unit", (F.col("toxic") > 0).cast("long").alias("toxic"), (F.col("clean") > 0).cast("long").alias("clean"),
        )
        .where(F.length("prefix").isin(*PREFIXES))
        .distinct()
        .groupBy(F.concat(F.lit("^"), "prefix").alias("unit"))
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    # Rows of `train` are bounded, and so are their words; one partition is held at a time.
    for table in (log_odds(prefixes, MIN_STEM).orderBy(F.length("unit")), log_odds(counts, MIN_SEEN)):
        for row in table.toLocalIterator():
            model.learn(row["unit"], row["weight"])


def _traits(model):
    """(toxic, tokens, best score, all scores) of training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(model.value)
        for batch in batches:
            out = []
            for text, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic"))):
                scores = np.array([memo[w] for w in words(text or "")])
                found = maximal_segments(scores)
                values, counts = np.unique(np.round(scores, 1), return_counts=True)
                out.append(
                    {
                        "toxic": toxic, "n": len(scores), "best": max((s for *_, s in found), default=0.0),
                        "segments": [s for *_, s in found], "values": values.tolist(), "counts": counts.tolist(),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, TRAITS)

    return run


TRAITS = pa.schema(
    [
        ("toxic", pa.int32()), ("n", pa.int64()), ("best", pa.float64()), ("segments", pa.list_(pa.float64())),
        ("values", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64())),
    ]
)


def chance_rate(histogram: dict[float, int]) -> float:
    """The positive lambda with mean(exp(lambda score)) = 1, at most MAX_LAMBDA."""
    total = sum(histogram.values())

    def mean(rate: float) -> float:
        return sum(c * math.exp(rate * v) for v, c in histogram.items()) / max(1, total)

    low, high = 0.0, MAX_LAMBDA
    if mean(high) <= 1:
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return max(low, 1e-3)


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept for binned data: y of n rows at x are 1; lightly held to 0."""
    a = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        slope = design.T @ (y - n * p) - 0.01 * a
        curve = design.T @ (design * (n * p * (1 - p))[:, None]) + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        a += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = TRAIN_ROWS) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    train = training_rows(docs, labels, held_out, rows)
    model = Model()
    if len(train.select("toxic").distinct().take(2)) < 2:
        return model
    learn_units(model, train)
    shared = spark.sparkContext.broadcast(model)
    schema = "toxic int, n long, best double, segments array<double>, values array<double>, counts array<long>"
    traits = stored(train.mapInArrow(_traits(shared), schema), "toxic-traits")
    shared.unpersist()
    clean = traits.where("toxic = 0")
    bars = clean.select(F.explode(F.arrays_zip("values", "counts")).alias("b")).groupBy("b.values").agg(
        F.sum("b.counts").alias("counts")
    )
    # Scores are rounded to 0.1: a few hundred rows.
    model.rate = chance_rate({r["values"]: r["counts"] for r in bars.collect()})
    fitted = clean.where("n > 0").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("n") * F.exp(-model.rate * F.col("best"))).alias("mass")
    ).first()
    model.k = fitted["docs"] / fitted["mass"] if fitted["docs"] and fitted["mass"] else 1.0
    limit = F.log(F.greatest(F.lit(model.k) * F.col("n"), F.lit(1e-300)))
    found = F.aggregate(
        "segments", F.lit(0.0), lambda s, v: s + F.greatest(F.lit(0.0), model.rate * v - limit)
    )
    bins = (
        traits.select(F.round(F.log1p(found), 1).alias("x"), "toxic").groupBy("x")
        .agg(F.sum("toxic").alias("y"), F.count(F.lit(1)).alias("n")).collect()
    )
    table = np.array([[b["x"], b["y"], b["n"]] for b in bins], float)
    model.slope, model.intercept = fit_logistic(*table.T)
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        memo = Memo(fitted)
        look = memo.__getitem__
        for batch in slices(batches, "text", WORK_BYTES):
            scores, n_tokens, passages = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = words(text)
                weights = np.fromiter(map(look, tokens), float, len(tokens))
                found = maximal_segments(weights) if len(tokens) and weights.max() > 0 else []
                n_tokens.append(len(tokens))
                scores.append(probability(fitted, evidence(fitted, found, len(tokens))))
                limit = math.log(max(fitted.k * len(tokens), 1e-300)) if tokens else 0.0
                good = [s for s in found if fitted.rate * s[2] > limit]
                places = [m.span() for m in WORD.finditer(text.lower())] if good else []
                passages.append(
                    [{"start": places[a][0], "stop": places[b - 1][1], "score": s} for a, b, s in good]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(n_tokens, pa.int64()),
                    pa.array(passages, PASSAGES),
                ],
                ["doc_id", "score", "n_tokens", "passages"],
            )

    return run


PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    held_out: Column,
    train_rows: int = TRAIN_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, score, n_tokens and its significant `passages`.

    `held_out` is a condition on `doc_id`: such rows' labels are not used.  Places of
    passages are characters of the lower-cased text.
    """
    ship_package(docs.sparkSession)
    own = picked(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text")
    )
    model = docs.sparkSession.sparkContext.broadcast(fit(own, labels, held_out, train_rows))
    return own.mapInArrow(
        _score(model),
        "doc_id long, score double, n_tokens long, passages array<struct<start:bigint,stop:bigint,score:double>>",
    )
