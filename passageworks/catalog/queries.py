"""The registered queries: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.catalog.inputs import CHUNK_TOKENS, PAIRED, TOPICS, Inputs
from passageworks.functions import fixed, text, vectors
from passageworks.functions.automaton import topic_label_wide
from passageworks.functions.tokens import REGEX_COUNTER
from passageworks.operators import chunking, documents, ivf, key_bits, packing, prompts, quality
from passageworks.operators import ranking, replies
from passageworks.operators.cells import bounded_topk, measure_cells, read_cells, write_cells
from passageworks.operators.codes import coded_topk, write_codes
from passageworks.operators.embedding import embed
from passageworks.operators.ids import dense_ids
from passageworks.operators.ordered import ordered_concat
from passageworks.plans.answer import answer_table, contexts_for
from passageworks.plans.index import IndexCounts, build_index
from passageworks.session import work_path
from passageworks.sources import tables
from passageworks.sources.questions import question_rows
from passageworks.sources.schemas import CHUNKS, TableSpec
from passageworks.streaming.questions import answer_stream, question_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ANN_LISTS, ANN_PROBES = 10, 8
BOUNDED_LISTS = 60
ANSWER_LISTS = 20
WIDE_CONTEXT, PIPELINE_CONTEXT = 12_000, 2_500
JOINED_GROUPS, JOINED_CONTEXT = 5, 12_000
WIDE_WORD, MAX_KEYWORDS = "[a-z]{4,}", 200_000


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, path: fn(Inputs(spark, path))
    return fn


# ---- sources, sinks, tables -------------------------------------------------


@query
def table_counts(t: Inputs) -> DataFrame:
    roles = {"users": t.users(), "tickets": t.tickets(), "messages": t.messages()}
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("role"), "n_rows")
        for name, df in roles.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def source_lookup(t: Inputs) -> DataFrame:
    """Bound parameter and equality filter on the source, a column of the chunk table."""
    path = work_path(t.spark, "lookup")
    tables.refresh_files(t.vector_chunks(), path)
    return t.spark.sql(
        "SELECT id, source_id FROM {chunks} WHERE source_id = :source",
        args={"source": 3},
        chunks=tables.read_files(t.spark, path),
    )


@query
def user_questions(t: Inputs) -> DataFrame:
    return question_rows(
        t.user_turns(), question="text", order="turn", session="conv_id"
    ).select(F.col("turn_id").alias("qid"), F.col("text").alias("question"))


@query
def chunk_table(t: Inputs) -> DataFrame:
    """Chunk, embed, write, read back."""
    docs = t.documents()
    path = work_path(t.spark, "chunks")
    return build_index(docs, path, max_tokens=CHUNK_TOKENS, topics=TOPICS).select(
        "id",
        "source_table",
        "source_id",
        F.char_length("content").alias("n_chars"),
        F.size("embedding").alias("dim"),
    )


@query
def index_report(t: Inputs) -> DataFrame:
    """How many documents were indexed as how many chunks, counted by the write."""
    counts = IndexCounts()
    build_index(
        t.documents(), work_path(t.spark, "counted"), max_tokens=CHUNK_TOKENS, topics=TOPICS, counts=counts
    )
    rows = [("documents", counts.documents), ("chunks", counts.chunks)]
    return t.spark.createDataFrame(rows, "role string, n_rows long")


@query
def managed_chunk_table(t: Inputs) -> DataFrame:
    """Drop, create, refresh, analyze; then the row count the catalog knows."""
    spark, name = t.spark, f"passageworks_chunks_{uuid.uuid4().hex}"
    tables.drop_tables(spark, [name])
    tables.create_if_missing(spark, name, CHUNKS, work_path(spark, name))
    tables.create_if_missing(spark, name, CHUNKS)
    rows = _stored_document_chunks(t).withColumn("source_table", F.lit(fixed.SOURCE_TABLE))
    tables.refresh_table(rows, name)
    tables.refresh_table(rows, name)
    tables.analyze(spark, name)
    known = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Statistics'")
    n = F.regexp_extract("data_type", r"(\d+) rows", 1).cast("long")
    return (
        spark.table(name)
        .groupBy("source_table", "source_id")
        .agg(F.count("*").alias("n_rows"))
        .withColumn("n_analyzed", F.lit(known.select(n).first()[0]).cast("long"))
    )


@query
def switched_chunk_table(t: Inputs) -> DataFrame:
    """A table whose files are switched twice, its first versions removed."""
    spark, name = t.spark, f"passageworks_switched_{uuid.uuid4().hex}"
    folder = work_path(spark, name)
    tables.create_if_missing(spark, name, CHUNKS, f"{folder}/version-0")
    rows = _stored_document_chunks(t).withColumn("source_table", F.lit(fixed.SOURCE_TABLE))
    old = tables.switch_table(rows.limit(1), name, folder)
    tables.switch_table(rows, name, folder)
    tables.drop_version(spark, name, old)
    return spark.table(name).select("id", "source_table", "source_id", F.char_length("content").alias("n_chars"))


@query
def dense_turn_ids(t: Inputs) -> DataFrame:
    rows = t.messages().select("ticket_id", "created_at", F.col("id").alias("message_id"))
    return dense_ids(rows, ["ticket_id", "created_at", "message_id"], "dense_id")


# ---- integrity --------------------------------------------------------------


@query
def constraint_report(t: Inputs) -> DataFrame:
    return _constraints(t, quality.check_table)


@query
def constraint_report_bits(t: Inputs) -> DataFrame:
    """The same report; dense integer keys are checked by bit tables."""
    return _constraints(t, key_bits.check_table_bits)


def _constraints(t: Inputs, check_table) -> DataFrame:
    users, tickets, messages = t.users(), t.tickets(), t.messages()
    user_spec = TableSpec(("id",), ("name", "email"), {"name": 17, "email": 20})
    ticket_spec = TableSpec(
        ("id",), ("user_id", "closed_at"), {"priority": 8}, foreign_keys=("user_id",)
    )
    message_spec = TableSpec(
        ("ticket_id", "created_at"), ("body",), {"body": 17}, foreign_keys=("ticket_id",)
    )
    chunk_spec = TableSpec(("id",), ("source_id",), vector_dims={"embedding": 64})
    parts = {
        "users": check_table(users, user_spec),
        "tickets": check_table(tickets, ticket_spec, {"user_id": (users, "id")}),
        "messages": check_table(messages, message_spec, {"ticket_id": (tickets, "id")}),
        "chunks": check_table(t.vector_chunks(), chunk_spec),
    }
    named = [df.select(F.lit(name).alias("role"), "*") for name, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


# ---- documents --------------------------------------------------------------


@query
def ticket_conversations(t: Inputs) -> DataFrame:
    rows = documents.ticket_rows(*_ticket_tables(t))
    return rows.select(
        "ticket_id",
        "user_name",
        text.timestamp_text(F.col("created_at")).alias("created"),
        text.text_or_null_word(text.timestamp_text(F.col("closed_at"))).alias("closed"),
        "conversation",
    )


@query
def document_assembly(t: Inputs) -> DataFrame:
    return documents.ticket_documents(*_ticket_tables(t))


def _ticket_tables(t: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    tickets = tables.spread(t.tickets(), "id")
    return tickets, t.users(), tables.spread(t.messages(), "ticket_id")


@query
def conversation_documents(t: Inputs) -> DataFrame:
    return _conversations(t)


def _conversations(t: Inputs) -> DataFrame:
    return ordered_concat(
        t.turns(), key="conv_id", text="line", order=["turn"], separator="\n", out="text"
    ).withColumnRenamed("conv_id", "doc_id")


@query
def role_transcripts(t: Inputs) -> DataFrame:
    """Lines of each role, a hundred conversations at a time: the segmented form."""
    block = F.concat_ws("-", "role", F.floor(F.col("conv_id") / 100))
    return ordered_concat(
        t.turns().withColumn("role_block", block), key="role_block", text="line",
        order=["turn_id"], separator="\n", out="transcript", hot_rows=50,
    )


# ---- text -------------------------------------------------------------------


@query
def paragraphs(t: Inputs) -> DataFrame:
    return chunking.paragraphs(t.documents())


@query
def sentences(t: Inputs) -> DataFrame:
    return chunking.sentences(t.document_paragraphs())


@query
def token_counts(t: Inputs) -> DataFrame:
    return t.document_paragraphs().select(
        "doc_id", REGEX_COUNTER.count(F.col("paragraph")).cast("long").alias("n_tok")
    )


@query
def text_functions(t: Inputs) -> DataFrame:
    body = F.col("paragraph")
    return t.document_paragraphs().select(
        "doc_id",
        F.lower(body).alias("lowered"),
        text.strip(F.concat(F.lit(" \t "), body, F.lit(" \n"))).alias("stripped"),
        text.collapse(body).alias("collapsed"),
        text.first_cut(body, [". ", "\n"]).alias("cut"),
        text.contains_any(F.lower(body), text.keyword_set(TOPICS)).alias("special"),
    )


@query
def topic_labels(t: Inputs) -> DataFrame:
    return chunking.paragraphs(t.documents()).select(
        "doc_id", "para_no", text.topic_label(F.col("paragraph"), TOPICS).alias("label")
    )


@query
def topic_labels_wide(t: Inputs) -> DataFrame:
    """Labels by all longer words of the benchmark items, a topic for each first letter."""
    words = t.table("benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WIDE_WORD), F.lit(0))).alias("word")
    ).distinct()
    topics: dict[str, list[str]] = {}
    for row in words.orderBy("word").limit(MAX_KEYWORDS + 1).collect():
        topics.setdefault(row.word[0], []).append(row.word)
    if sum(map(len, topics.values())) > MAX_KEYWORDS:
        raise ValueError("more keywords than a driver should hold")
    return chunking.paragraphs(t.documents()).select(
        "doc_id", "para_no", topic_label_wide(t.spark, F.col("paragraph"), topics).alias("label")
    )


@query
def sentence_chunks(t: Inputs) -> DataFrame:
    return chunking.sentence_chunks(t.document_paragraphs())


@query
def hybrid_chunks(t: Inputs) -> DataFrame:
    return chunking.hybrid_chunks(t.documents(), max_tokens=CHUNK_TOKENS, topics=TOPICS)


# ---- vectors ----------------------------------------------------------------


@query
def hash_embeddings(t: Inputs) -> DataFrame:
    vecs = embed(t.document_paragraphs(), "paragraph")
    return (
        vecs.select("doc_id", F.posexplode_outer("embedding").alias("component", "v"))
        .filter("v <> 0")
        .select("doc_id", "component", F.round(F.col("v").cast("double"), 6).alias("v"))
    )


@query
def vector_distances(t: Inputs) -> DataFrame:
    """Distance of neighbouring vectors, and of a vector to its doubled self made
    unit length again."""
    a = t.vector_questions()
    b = t.vector_questions().select(
        (F.col("qid") - 1).alias("qid"), F.col("embedding").alias("other")
    )
    doubled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 2)
    d = vectors.l2_distance(F.col("embedding"), F.col("other"))
    return a.join(b, "qid").select(
        "qid",
        F.round(d, 6).alias("d"),
        F.round(vectors.score(d), 6).alias("score"),
        F.round(
            vectors.l2_distance(vectors.normalise(doubled), F.col("other")), 6
        ).alias("d_unit"),
    )


# ---- retrieval --------------------------------------------------------------


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def candidate_topk(t: Inputs) -> DataFrame:
    return _rounded(ranking.candidates(t.vector_chunks(), t.vector_questions()), "score")


@query
def group_scores(t: Inputs) -> DataFrame:
    hits = ranking.candidates(t.vector_chunks(), t.vector_questions())
    return _rounded(ranking.group_scores(hits), "score")


@query
def group_chunks_topk(t: Inputs) -> DataFrame:
    """Every chunk's own source as its group, searched with its own vector."""
    own = t.vector_chunks().filter("source_id IS NOT NULL").select(
        F.col("id").alias("qid"),
        "source_id",
        F.lit(1).alias("group_rank"),
        F.lit(1.0).alias("score"),
    )
    hits = ranking.group_chunks(t.vector_chunks(), t.vector_questions(), own)
    return hits.select("qid", "source_id", "chunk_id", "d", "rank")


@query
def ticket_lookup_lateral(t: Inputs) -> DataFrame:
    """Every chunk's own source, by a correlated lookup over chunks laid out by source."""
    path = work_path(t.spark, "by-source")
    chunks = t.vector_chunks().filter("source_id IS NOT NULL")
    chunks.repartitionByRange("source_id", "id").write.parquet(path)
    laid = tables.read_files(t.spark, path)
    asked = laid.select(F.col("id").alias("qid"), "source_id", "embedding")
    return ranking.lateral_chunks(laid, asked)


@query
def two_stage_retrieval(t: Inputs) -> DataFrame:
    hits = ranking.retrieve(t.vector_chunks(), t.vector_questions())
    return _rounded(hits, "score", "group_score")


@query
def text_retrieval(t: Inputs) -> DataFrame:
    """User turns against whole documents, both embedded from text."""
    chunks = _stored_document_chunks(t)
    return _rounded(ranking.retrieve(chunks, _question_vectors(t)), "score", "group_score")


def _question_vectors(t: Inputs) -> DataFrame:
    return embed(_questions(t), "question").select("qid", "embedding")


def _stored_document_chunks(t: Inputs) -> DataFrame:
    path = work_path(t.spark, "chunks")
    sized = t.document_chunks().withColumn("n_tok", REGEX_COUNTER.count(F.col("content")))
    tables.refresh_files(embed(sized), path)
    return tables.spread(tables.read_files(t.spark, path))


def _questions(t: Inputs) -> DataFrame:
    return t.user_turns().select(
        F.col("turn_id").alias("qid"), text.strip(F.col("text")).alias("question")
    )


def _lists(t: Inputs, centres) -> DataFrame:
    path = work_path(t.spark, "ivf")
    ivf.write_index(t.vector_chunks(), centres, path)
    return ivf.read_index(t.spark, path)


def _label_centres(t: Inputs) -> np.ndarray:
    """The vector of the smallest id of each label."""
    first = t.table("embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return np.array([r.v for r in first.orderBy("label").collect()], np.float64)


def _ann_few(t: Inputs, k: int) -> DataFrame:
    centres = _label_centres(t)
    return ivf.ann_topk(_lists(t, centres), t.vector_questions(), centres, ANN_PROBES, k)


@query
def ann_exact(t: Inputs) -> DataFrame:
    centres = ivf.fit_centres(t.vector_chunks(), ANN_LISTS)
    return ivf.ann_topk(
        _lists(t, centres), t.vector_questions(), centres, ANN_LISTS, fixed.TOP_K
    )


@query
def ann_bounded(t: Inputs) -> DataFrame:
    """The nearest, through cells whose radii show when to stop."""
    centres = ivf.fit_centres(t.vector_chunks(), BOUNDED_LISTS)
    indexed = _lists(t, centres)
    found = bounded_topk(indexed, t.vector_questions(), measure_cells(indexed, centres), first=8)
    return found.hits.select(
        "qid", "chunk_id", "source_id", "d", F.round(vectors.score(F.col("d")), 6).alias("score"), "rank"
    )


@query
def candidate_topk_codes(t: Inputs) -> DataFrame:
    """The nearest, by codes of one byte per component; vectors in full where they may win."""
    indexed = _lists(t, ivf.fit_centres(t.vector_chunks(), ANN_LISTS))
    found = coded_topk(write_codes(indexed), indexed, t.vector_questions(), cell="cell")
    return found.hits.select(
        "qid", "chunk_id", "source_id", "d", F.round(vectors.score(F.col("d")), 6).alias("score"), "rank"
    )


@query
def ann_few_probes(t: Inputs) -> DataFrame:
    return _ann_few(t, fixed.TOP_K)


@query
def two_stage_ann(t: Inputs) -> DataFrame:
    """Two-stage retrieval over inverted lists, all of them probed."""
    centres = ivf.fit_centres(t.vector_chunks(), ANN_LISTS)
    hits = ranking.retrieve(
        _lists(t, centres), t.vector_questions(), index=ivf.Lists(centres, ANN_LISTS)
    )
    return _rounded(hits, "score", "group_score")


@query
def ann_recall(t: Inputs) -> DataFrame:
    """Share of the true nearest found with few probes, per question."""
    found = _ann_few(t, fixed.TOP_K).select("qid", "chunk_id", F.lit(1).alias("hit"))
    true = ranking.candidates(t.vector_chunks(), t.vector_questions(), fixed.TOP_K)
    return (
        true.join(found, ["qid", "chunk_id"], "left")
        .groupBy("qid")
        .agg((F.count("hit") / F.count("*")).alias("recall"))
    )


# ---- contexts, prompts, replies ---------------------------------------------


@query
def context_blocks(t: Inputs) -> DataFrame:
    chunks, questions = _stored_document_chunks(t), _question_vectors(t)
    hits = ranking.retrieve(chunks, questions, top_k=3)
    return packing.group_blocks(ranking.with_content(hits, chunks))


@query
def context_pack(t: Inputs) -> DataFrame:
    return contexts_for(_stored_document_chunks(t), _question_vectors(t), counts="n_tok")


@query
def context_pack_wide(t: Inputs) -> DataFrame:
    return contexts_for(
        _stored_document_chunks(t), _question_vectors(t), max_context=WIDE_CONTEXT, counts="n_tok"
    )


@query
def context_pack_joined(t: Inputs) -> DataFrame:
    """Five groups, with a counter whose counts do not add up: joined texts are counted."""
    return contexts_for(
        _stored_document_chunks(t), _question_vectors(t), groups=JOINED_GROUPS,
        max_context=JOINED_CONTEXT, counter=PAIRED,
    )


@query
def sentence_pack(t: Inputs) -> DataFrame:
    """Leading sentences of each document within a budget."""
    items = chunking.sentences(t.document_paragraphs()).withColumnRenamed("sent_no", "rank")
    return packing.pack_items(
        items, key="doc_id", item="sentence", header="Text:\n",
        separator=fixed.CHUNK_SEPARATOR, max_context=150, reserve=50,
    )


def _prompts(t: Inputs) -> DataFrame:
    """User turns; the whole conversation is the context."""
    contexts = (
        t.turns()
        .groupBy("conv_id")
        .agg(packing.joined_in_order("line", "\n", "turn").alias("context"))
    )
    keyed = t.user_turns().select("conv_id", F.col("turn_id").alias("qid"))
    return prompts.with_prompts(
        _questions(t), keyed.join(contexts, "conv_id").select("qid", "context")
    )


@query
def prompt_rows(t: Inputs) -> DataFrame:
    return _prompts(t).select("qid", "prompt", "reply")


@query
def chat_requests(t: Inputs) -> DataFrame:
    return prompts.chat_requests(_prompts(t))


@query
def response_audit(t: Inputs) -> DataFrame:
    """Assistant turns as model replies, the conversation's user turns as context."""
    quote = F.regexp_extract("text", r"^[^.]*[.]?", 0)  # up to the first full stop
    content = F.concat(
        F.lit(" " + fixed.ANSWER_CAPTION + " "),
        F.col("text"),
        F.lit("\n" + fixed.QUOTE_CAPTION + ' "'),
        F.translate(quote, '"\n', ""),
        F.lit('"\n'),
    )
    raw = F.to_json(F.struct(F.struct(content.alias("content")).alias("message")))
    contexts = (
        t.user_turns()
        .groupBy("conv_id")
        .agg(packing.joined_in_order("text", "\n", "turn").alias("context"))
    )
    responses = (
        t.turns()
        .filter("role = 'assistant'")
        .join(contexts, "conv_id")
        .select(F.col("turn_id").alias("qid"), raw.alias("raw_json"), "context")
    )
    stops = [*fixed.STOP_SEQUENCES, "tion"]
    return replies.audit_replies(responses, stops).withColumn(
        "n_sentences", F.col("n_sentences").cast("long")
    )


@query
def answer_pipeline(t: Inputs) -> DataFrame:
    """Conversations indexed, every user turn asked, requests packed."""
    chunks = build_index(
        _conversations(t), work_path(t.spark, "pipeline"),
        max_tokens=CHUNK_TOKENS, topics=TOPICS,
    )
    return answer_table(
        tables.spread(chunks), _questions(t), max_context=PIPELINE_CONTEXT, counts="n_tok"
    ).select(
        "qid", "context", "reply", "request"
    )


@query
def answer_cells(t: Inputs) -> DataFrame:
    """As `answer_pipeline`; indexing also writes cells, and answers search through them."""
    cells = work_path(t.spark, "cells")
    chunks = build_index(
        _conversations(t), work_path(t.spark, "pipeline"), cells=cells, lists=ANSWER_LISTS,
        max_tokens=CHUNK_TOKENS, topics=TOPICS,
    )
    return answer_table(
        tables.spread(chunks), _questions(t), max_context=PIPELINE_CONTEXT, counts="n_tok",
        index=read_cells(t.spark, cells),
    ).select("qid", "context", "reply", "request")


@query
def ticket_answers(t: Inputs) -> DataFrame:
    """The three ticket tables to answers, with the default topics and limits."""
    chunks = build_index(
        documents.ticket_documents(*_ticket_tables(t)), work_path(t.spark, "tickets")
    )
    return answer_table(
        tables.spread(chunks), _questions(t), max_context=PIPELINE_CONTEXT, counts="n_tok"
    ).select("qid", "context", "reply", "request")


@query
def question_stream_answers(t: Inputs) -> DataFrame:
    """User turns arriving as JSON files, asked against whole documents."""
    return _streamed(t, _stored_document_chunks(t))


@query
def question_stream_cells(t: Inputs) -> DataFrame:
    """The same through cells written once, of which each micro-batch reads what it needs."""
    chunks, cells = _stored_document_chunks(t), work_path(t.spark, "cells")
    write_cells(chunks, cells, ANSWER_LISTS)
    return _streamed(t, chunks, index=read_cells(t.spark, cells))


def _streamed(t: Inputs, chunks: DataFrame, **options) -> DataFrame:
    source, out, state = (work_path(t.spark, n) for n in ("ask", "answers", "state"))
    _questions(t).write.json(source)
    stream = answer_stream(
        question_stream(t.spark, source), chunks, out, state,
        available_now=True, max_context=WIDE_CONTEXT, counts="n_tok", **options,
    )
    stream.awaitTermination()
    return t.spark.read.parquet(out).select("qid", "prompt", "reply")
