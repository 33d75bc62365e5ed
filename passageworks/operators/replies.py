"""Replies of a chat model, held as JSON rows: extraction and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.functions import fixed
from passageworks.functions.text import first_cut, split_sentences, strip

REPLY_SCHEMA = "message struct<content:string>"
MIN_SENTENCES, MAX_SENTENCES = 2, 5


def reply_text(raw_json: Column, stops: Sequence[str] = fixed.STOP_SEQUENCES) -> Column:
    """Message content, cut at the first stop sequence and stripped.

    A missing message, a NULL content and broken JSON all give an empty text.
    """
    content = F.from_json(raw_json, REPLY_SCHEMA)["message"]["content"]
    return strip(first_cut(F.coalesce(content, F.lit("")), stops))


def audit_replies(responses: DataFrame, stops: Sequence[str] = fixed.STOP_SEQUENCES) -> DataFrame:
    """The other columns of (raw_json, context), with the reply and its checks.

    answer and quote come from the answer format; without its captions the whole
    reply is the answer.  quote_found: the quote occurs verbatim in the context.
    declined: the answer is the fixed not-in-context sentence.
    """
    body = responses.withColumn("reply", reply_text(F.col("raw_json"), stops))
    pieces = F.split("reply", rf"\Q{fixed.QUOTE_CAPTION}\E", 2)
    head = F.element_at(pieces, 1)
    caption = F.lit(fixed.ANSWER_CAPTION)
    answer = F.when(
        F.contains(head, caption),
        F.element_at(F.split(head, rf"\Q{fixed.ANSWER_CAPTION}\E", 2), 2),
    ).otherwise(head)
    tail = F.when(F.size(pieces) > 1, strip(F.element_at(pieces, 2)))
    quote = F.nullif(F.regexp_extract(tail, '(?s)^"(.*)"', 1), F.lit(""))
    parsed = body.withColumns({"answer": strip(answer), "quote": quote})
    n = F.size(split_sentences(F.col("answer")))
    return (
        parsed.withColumn("n_sentences", n)
        .withColumn(
            "length_ok", F.col("n_sentences").between(MIN_SENTENCES, MAX_SENTENCES)
        )
        .withColumn(
            "quote_found",
            F.coalesce(F.contains(F.col("context"), F.col("quote")), F.lit(False)),
        )
        .withColumn("declined", F.col("answer") == F.lit(fixed.DECLINED_REPLY))
        .drop("raw_json", "context")
    )
