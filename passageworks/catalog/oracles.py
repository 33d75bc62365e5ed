"""SQL for DuckDB with the same results as the registered queries.

The statements are built from named pieces (`WITH` parts), so that a mapping or a
text rule is stated once.
"""

from __future__ import annotations

from passageworks.catalog.inputs import CHUNK_TOKENS, TOPICS
from passageworks.catalog.queries import ANN_PROBES, JOINED_CONTEXT, JOINED_GROUPS
from passageworks.catalog.queries import PIPELINE_CONTEXT, WIDE_CONTEXT, WIDE_WORD
from passageworks.functions import fixed
from passageworks.functions.text import WS_CLASS
from passageworks.functions.tokens import TOKEN_PATTERN

ORACLES: dict[str, str] = {}


def lit(value: str) -> str:
    """A SQL string literal; line breaks through chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS_CLASS}+', ''), '{WS_CLASS}+$', '')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS_CLASS}+', ' ', 'g')"


def n_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN_PATTERN}'))"


def sentence_list(x: str) -> str:
    marked = f"regexp_replace({strip(collapse(x))}, '([.!?]) ', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"


def paragraph_list(x: str) -> str:
    parts = f"string_split_regex({x}, '\\n{WS_CLASS}*\\n')"
    return f"list_filter(list_transform({parts}, lambda p: {strip('p')}), lambda p: p <> '')"


def label(x: str, topics=TOPICS) -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({x}), {lit(w)})' for w in words)} "
        f"THEN {lit(f'[{topic}]')}"
        for topic, words in topics.items()
    )
    return f"CASE {cases} ELSE {lit(fixed.DEFAULT_LABEL)} END"


USERS = """users AS (SELECT c_custkey AS id, c_name AS name,
  lower(c_mktsegment) || '@example.org' AS email FROM customer)"""
TICKETS = """tickets AS (SELECT o_orderkey AS id, o_custkey AS user_id,
  'Order ' || o_orderkey AS title, o_orderstatus AS status, o_orderpriority AS priority,
  CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS category,
  o_orderdate AS created_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS closed_at FROM orders)"""
MESSAGES = """messages AS (SELECT
  (l_partkey * 10000000 + l_suppkey) * 10 + l_linenumber AS id, l_orderkey AS ticket_id,
  l_returnflag AS sender_type, 'Supplier ' || l_suppkey AS sender_name,
  'part ' || l_partkey || ' line ' || l_linenumber || ' ' || l_linestatus AS body,
  l_shipdate AS created_at FROM lineitem)"""
TICKET_ROWS = f"""{USERS}, {TICKETS}, {MESSAGES},
ticket_rows AS (
  SELECT t.id AS ticket_id, t.title AS ticket_title, u.name AS user_name,
    u.email AS user_email, t.status, t.priority, t.category, t.created_at, t.closed_at,
    string_agg('[' || m.sender_type || '] ' || m.sender_name || ': ' || m.body, chr(10)
      ORDER BY m.created_at, m.id) AS conversation
  FROM tickets t JOIN users u ON u.id = t.user_id LEFT JOIN messages m ON m.ticket_id = t.id
  GROUP BY t.id, t.title, u.name, u.email, t.status, t.priority, t.category,
    t.created_at, t.closed_at)"""
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
TURNS = """turns AS (SELECT conv_id, turn, role, text, conv_id * 1000 + turn AS turn_id,
  '[' || role || '] ' || text AS line FROM conversations)"""
DOCS = "docs AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"
CONVERSATIONS = f"""{TURNS}, docs AS (SELECT conv_id AS doc_id,
  string_agg(line, chr(10) ORDER BY turn) AS text FROM turns GROUP BY conv_id)"""
QUESTIONS = f"""questions AS (SELECT turn_id AS qid, {strip('text')} AS question
  FROM turns WHERE role = 'user')"""
PARAS = f"""para_lists AS (SELECT doc_id, {paragraph_list('text')} AS ps FROM docs),
paras AS (SELECT doc_id, unnest(range(1, len(ps) + 1))::INTEGER AS para_no,
  unnest(ps) AS paragraph FROM para_lists)"""


def windows(max_tokens: int) -> str:
    """Sentence ranges of `split` (key, ss), one recursion step per sentence."""
    overlap = max(10, int(max_tokens * 0.15))
    return f"""counted AS (SELECT key, ss,
  list_transform(ss, lambda s: {n_tokens('s')}) AS ns FROM split WHERE len(ss) > 0),
fold AS (
  SELECT key, ns, 0 AS i, 0 AS lo, 0::BIGINT AS used, []::INTEGER[][] AS emitted FROM counted
  UNION ALL
  SELECT key, ns, i + 1,
    CASE WHEN n > {max_tokens} THEN i + 1 WHEN used + n <= {max_tokens} THEN lo
      ELSE greatest(lo, i - {overlap}) END,
    CASE WHEN n > {max_tokens} THEN 0 WHEN used + n <= {max_tokens} THEN used + n
      ELSE list_sum(ns[greatest(lo, i - {overlap}) + 1 : i + 1])::BIGINT END,
    CASE WHEN n > {max_tokens} AND lo < i THEN [[lo + 1, i], [i + 1, i + 1]]
      WHEN n > {max_tokens} THEN [[i + 1, i + 1]]
      WHEN used + n <= {max_tokens} THEN []::INTEGER[][]
      ELSE [[lo + 1, i]] END
  FROM (SELECT *, ns[i + 1] AS n FROM fold WHERE i < len(ns))),
ranges AS (
  SELECT key, i, unnest(emitted) AS r FROM fold
  UNION ALL
  SELECT key, i + 1, [lo + 1, i] FROM fold WHERE i = len(ns) AND lo < i),
windows AS (
  SELECT r.key, row_number() OVER (PARTITION BY r.key ORDER BY r.i, r.r[1]) AS piece_no,
    array_to_string(c.ss[r.r[1] : r.r[2]], ' ') AS body
  FROM ranges r JOIN counted c USING (key))"""


def hybrid(topics, max_tokens: int) -> str:
    """`pieces`: the labelled chunks of `docs`."""
    return f"""{PARAS},
sized AS (SELECT *, {label('paragraph', topics)} AS label, {n_tokens('paragraph')} AS n FROM paras),
split AS (SELECT {{doc_id: doc_id, para_no: para_no}} AS key,
  {sentence_list('paragraph')} AS ss FROM sized
  WHERE label = {lit(fixed.DEFAULT_LABEL)} AND n > {max_tokens}),
{windows(max_tokens)},
pieces AS (
  SELECT doc_id, para_no, 1 AS piece_no, label, label || ' ' || paragraph AS content
  FROM sized WHERE NOT (label = {lit(fixed.DEFAULT_LABEL)} AND n > {max_tokens})
  UNION ALL
  SELECT key.doc_id, key.para_no, piece_no, {lit(fixed.DEFAULT_LABEL)},
    {lit(fixed.DEFAULT_LABEL)} || ' ' || body FROM windows)"""


HYBRID = hybrid(TOPICS, CHUNK_TOKENS)


def embedded(name: str, source: str, key: str, text: str) -> str:
    """`name` (key, v): hashed unit vectors of a table's text as DOUBLE[]."""
    dim = fixed.EMBEDDING_DIM
    return f"""{name}_words AS (SELECT {key} AS key,
  unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {source}),
{name}_codes AS (SELECT w, ('0x' || substr(md5(w), 1, 7))::BIGINT AS h
  FROM (SELECT DISTINCT w FROM {name}_words)),
{name}_cells AS (SELECT key, (h % {dim})::INTEGER AS component,
  sum(CASE WHEN (h // {dim}) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS n
  FROM {name}_words JOIN {name}_codes USING (w) GROUP BY ALL),
{name}_norms AS (SELECT key, sqrt(sum(n * n)) AS norm FROM {name}_cells GROUP BY key),
{name}_parts AS (SELECT key, component, CASE WHEN norm > 0 THEN n / norm ELSE 0 END AS x
  FROM {name}_cells JOIN {name}_norms USING (key)),
{name} AS MATERIALIZED (SELECT s.key, list(coalesce(p.x, 0)::FLOAT ORDER BY s.component)::DOUBLE[] AS v
  FROM (SELECT {key} AS key, unnest(range({dim}))::INTEGER AS component FROM {source}) s
  LEFT JOIN {name}_parts p ON p.key = s.key AND p.component = s.component GROUP BY s.key)"""


VECTORS = """chunks AS MATERIALIZED (SELECT vec_id AS id, nullif(label, 0)::BIGINT AS source_id,
  embedding::DOUBLE[] AS v FROM embeddings),
asked AS MATERIALIZED (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings)"""


def candidates(k: int) -> str:
    return f"""hits AS MATERIALIZED (
  SELECT *, (1 / (1 + d)) AS score FROM (
    SELECT qid, chunk_id, source_id, d,
      row_number() OVER (PARTITION BY qid ORDER BY d, chunk_id)::INTEGER AS rank
    FROM (SELECT a.qid, c.id AS chunk_id, c.source_id,
      round(list_distance(a.v, c.v), 9) AS d FROM asked a, chunks c))
  WHERE rank <= {k})"""


SCORES = """scores AS MATERIALIZED (
  SELECT qid, source_id, score, best_rank,
    row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, best_rank)::INTEGER
      AS group_rank
  FROM (SELECT qid, source_id, sum(score) AS score, min(rank) AS best_rank
    FROM hits WHERE source_id IS NOT NULL GROUP BY ALL))"""


def inside(groups: int, top_k: int) -> str:
    return f"""inside AS (
  SELECT qid, source_id, group_rank, group_score, chunk_id, d, 1 / (1 + d) AS score, rank
  FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY d, chunk_id)::INTEGER
      AS rank
    FROM (SELECT s.qid, s.source_id, s.group_rank, s.score AS group_score, c.id AS chunk_id,
        round(list_distance(a.v, c.v), 9) AS d
      FROM scores s JOIN asked a USING (qid) JOIN chunks c ON c.source_id = s.source_id
      WHERE s.group_rank <= {groups}))
  WHERE rank <= {top_k})"""


def retrieval(top_k: int = fixed.TOP_K) -> str:
    k, groups = fixed.CANDIDATE_K, fixed.TOP_GROUPS
    return f"{candidates(k)}, {SCORES}, {inside(groups, top_k)}"


RETRIEVED = """SELECT qid, source_id, group_rank, round(group_score, 6) AS group_score,
  chunk_id, d, round(score, 6) AS score, rank FROM inside"""


def contexts(max_context: int) -> str:
    """Blocks and packed contexts of `inside` with `contents` (id, content)."""
    before, after = fixed.BLOCK_CAPTION.split("{}")
    header, sep = lit(fixed.CONTEXT_HEADER), lit(fixed.BLOCK_SEPARATOR)
    budget = f"({max_context - fixed.RESERVE_FOR_ANSWER} - {n_tokens(header)})"
    return f"""blocks AS (SELECT qid, group_rank AS rank, {lit(before)} || inside.source_id || {lit(after)}
    || string_agg(content, {lit(fixed.CHUNK_SEPARATOR)} ORDER BY inside.rank) AS block
  FROM inside JOIN contents ON contents.id = chunk_id GROUP BY qid, inside.source_id, group_rank),
costs AS (SELECT *, sum({n_tokens('block')} + CASE WHEN rank > 1 THEN {n_tokens(sep)} ELSE 0 END)
    OVER (PARTITION BY qid ORDER BY rank) AS used FROM blocks),
contexts AS (SELECT qid, coalesce(string_agg(block, {sep} ORDER BY rank)
    FILTER (WHERE used <= {budget}), '') AS context FROM costs GROUP BY qid)"""


ROUTED = f"""routed AS (SELECT qid, question, coalesce(context, '') AS context,
  CASE WHEN coalesce(context, '') <> '' THEN {strip(f'''({lit(fixed.CONTEXT_HEADER)} || context
    || {lit(chr(10) * 2 + fixed.QUESTION_CAPTION)} || question || chr(10))''')} END AS prompt,
  CASE WHEN coalesce(context, '') = '' THEN {lit(fixed.NO_CONTEXT_REPLY)} END AS reply
  FROM questions LEFT JOIN contexts USING (qid))"""
REQUEST = f"""to_json({{model: {lit(fixed.CHAT_MODEL)}, stream: false,
  messages: [{{role: 'system', content: {lit(fixed.SYSTEM_PROMPT)}}},
    {{role: 'user', content: prompt}}],
  options: {{temperature: 0.0::DOUBLE, num_predict: {fixed.MAX_REPLY_TOKENS},
    stop: [{', '.join(map(lit, fixed.STOP_SEQUENCES))}]}}}})::VARCHAR"""
TURN_CONTEXTS = """contexts AS (SELECT turn_id AS qid, c.context FROM turns JOIN (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS context FROM turns
  GROUP BY conv_id) c
  USING (conv_id) WHERE role = 'user')"""
DOCUMENT_CHUNKS = f"""contents AS (SELECT doc_id AS id,
  regexp_extract(source, '(\\d+)$', 1)::BIGINT AS source_id, text AS content FROM documents),
{embedded('content_vectors', 'contents', 'id', 'content')},
chunks AS MATERIALIZED (SELECT id, source_id, v FROM contents
  JOIN content_vectors ON key = id)"""
ASKED = f"""{embedded('question_vectors', 'questions', 'qid', 'question')},
asked AS MATERIALIZED (SELECT key AS qid, v FROM question_vectors)"""
NUMBERED = """numbered AS MATERIALIZED (SELECT row_number() OVER (
  ORDER BY doc_id, para_no, piece_no) AS id, doc_id AS source_id, content FROM pieces)"""


def checks(role: str, table: str, rows: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{role}' AS role, '{kind}' AS "check", '{column}' AS "column",
        (SELECT ({n})::BIGINT FROM {table}) AS n_bad"""
        for kind, column, n in rows
    )


def bad(test: str) -> str:
    return f"count(*) FILTER (WHERE {test})"


ORACLES["table_counts"] = f"""WITH {USERS}, {TICKETS}, {MESSAGES}
SELECT 'users' AS role, count(*) AS n_rows FROM users
UNION ALL SELECT 'tickets', count(*) FROM tickets
UNION ALL SELECT 'messages', count(*) FROM messages"""

ORACLES["source_lookup"] = """SELECT vec_id AS id, nullif(label, 0)::BIGINT AS source_id
FROM embeddings WHERE label = 3"""

ORACLES["user_questions"] = f"""WITH {TURNS}, asked AS (
  SELECT conv_id, turn, turn_id, {strip("coalesce(text, '')")} AS question FROM turns
  WHERE role = 'user'),
ends AS (SELECT conv_id, min(turn) AS stop FROM asked
  WHERE lower(question) IN ('exit', 'quit') GROUP BY conv_id)
SELECT turn_id AS qid, question FROM asked LEFT JOIN ends USING (conv_id)
WHERE question <> '' AND (stop IS NULL OR turn < stop)"""

ORACLES["chunk_table"] = f"""WITH RECURSIVE {DOCS}, {HYBRID}, {NUMBERED}
SELECT id, 'tickets' AS source_table, source_id, length(content)::INTEGER AS n_chars,
  {fixed.EMBEDDING_DIM}::INTEGER AS dim FROM numbered"""

ORACLES["index_report"] = f"""WITH RECURSIVE {DOCS}, {HYBRID}
SELECT 'documents' AS role, count(*) AS n_rows FROM docs
UNION ALL SELECT 'chunks', count(*) FROM pieces"""

ORACLES["managed_chunk_table"] = f"""WITH {DOCUMENT_CHUNKS}
SELECT 'tickets' AS source_table, source_id, count(*) AS n_rows,
  (SELECT count(*) FROM chunks) AS n_analyzed FROM chunks GROUP BY source_id"""

ORACLES["switched_chunk_table"] = f"""WITH {DOCUMENT_CHUNKS}
SELECT id, 'tickets' AS source_table, chunks.source_id, length(content)::INTEGER AS n_chars
FROM chunks JOIN contents USING (id)"""

ORACLES["dense_turn_ids"] = f"""WITH {MESSAGES}
SELECT ticket_id, created_at, id AS message_id,
  row_number() OVER (ORDER BY ticket_id, created_at, id) AS dense_id FROM messages"""

ORACLES["constraint_report"] = f"""WITH {USERS}, {TICKETS}, {MESSAGES}, {VECTORS}
{checks('users', 'users', [
    ('not_null', 'id', bad('id IS NULL')),
    ('not_null', 'name', bad('name IS NULL')),
    ('not_null', 'email', bad('email IS NULL')),
    ('max_length', 'name', bad('length(name) > 17')),
    ('max_length', 'email', bad('length(email) > 20')),
    ('unique', 'id', 'count(*) - count(DISTINCT id)'),
])} UNION ALL {checks('tickets', 'tickets', [
    ('not_null', 'id', bad('id IS NULL')),
    ('not_null', 'user_id', bad('user_id IS NULL')),
    ('not_null', 'closed_at', bad('closed_at IS NULL')),
    ('max_length', 'priority', bad('length(priority) > 8')),
    ('unique', 'id', 'count(*) - count(DISTINCT id)'),
    ('foreign_key', 'user_id', bad('user_id NOT IN (SELECT id FROM users)')),
])} UNION ALL {checks('messages', 'messages', [
    ('not_null', 'ticket_id', bad('ticket_id IS NULL')),
    ('not_null', 'created_at', bad('created_at IS NULL')),
    ('not_null', 'body', bad('body IS NULL')),
    ('max_length', 'body', bad('length(body) > 17')),
    ('unique', 'ticket_id,created_at', 'count(*) - count(DISTINCT (ticket_id, created_at))'),
    ('foreign_key', 'ticket_id',
     bad("ticket_id NOT IN (SELECT id FROM tickets)")),
])} UNION ALL {checks('chunks', 'chunks', [
    ('not_null', 'id', bad('id IS NULL')),
    ('not_null', 'source_id', bad('source_id IS NULL')),
    ('dimension', 'embedding', bad('len(v) <> 64')),
    ('unique', 'id', 'count(*) - count(DISTINCT id)'),
])}"""

ORACLES["constraint_report_bits"] = ORACLES["constraint_report"]

ORACLES["ticket_conversations"] = f"""WITH {TICKET_ROWS}
SELECT ticket_id, user_name, {TS.format('created_at')} AS created,
  coalesce({TS.format('closed_at')}, 'None') AS closed, conversation FROM ticket_rows"""

_CAP = {name: lit(caption) for name, caption in fixed.TICKET_CAPTIONS.items()}
TICKET_TEXT = f"""SELECT ticket_id AS doc_id, {_CAP['id']} || ticket_id || {_CAP['title']} || ticket_title
  || {_CAP['user']} || user_name || ' (' || user_email || ')' || {_CAP['status']} || status
  || {_CAP['priority']} || priority || {_CAP['category']} || category
  || {_CAP['created']} || {TS.format('created_at')}
  || {_CAP['closed']} || coalesce({TS.format('closed_at')}, 'None')
  || {_CAP['conversation']} || coalesce(conversation, '') AS text FROM ticket_rows"""
ORACLES["document_assembly"] = f"WITH {TICKET_ROWS} {TICKET_TEXT}"

ORACLES["conversation_documents"] = f"WITH {CONVERSATIONS} SELECT doc_id, text FROM docs"

ORACLES["role_transcripts"] = f"""WITH {TURNS}
SELECT role || '-' || (conv_id // 100) AS role_block,
  string_agg(line, chr(10) ORDER BY turn_id) AS transcript FROM turns GROUP BY ALL"""

ORACLES["paragraphs"] = f"WITH {DOCS}, {PARAS} SELECT doc_id, para_no, paragraph FROM paras"

_SENTENCES = f"""sentence_lists AS (SELECT doc_id, {sentence_list('text')} AS ss FROM documents),
sentences AS (SELECT doc_id, unnest(range(1, len(ss) + 1))::INTEGER AS sent_no,
  unnest(ss) AS sentence FROM sentence_lists)"""
ORACLES["sentences"] = f"WITH {_SENTENCES} SELECT doc_id, sent_no, sentence FROM sentences"

ORACLES["token_counts"] = f"SELECT doc_id, {n_tokens('text')} AS n_tok FROM documents"

ORACLES["text_functions"] = f"""SELECT doc_id, lower(text) AS lowered,
  {strip("(' ' || chr(9) || ' ' || text || ' ' || chr(10))")} AS stripped,
  {collapse('text')} AS collapsed,
  string_split_regex(text, '\\. |\\n')[1] AS cut,
  {' OR '.join(f'contains(lower(text), {lit(w)})' for ws in TOPICS.values() for w in ws)} AS special
FROM documents"""

ORACLES["topic_labels"] = f"""WITH {DOCS}, {PARAS}
SELECT doc_id, para_no, {label('paragraph')} AS label FROM paras"""

ORACLES["topic_labels_wide"] = f"""WITH {DOCS}, {PARAS},
keywords AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WIDE_WORD}')) AS word FROM benchmark),
hits AS (SELECT doc_id, para_no, min(word[1]) AS letter
  FROM paras JOIN keywords ON contains(lower(paragraph), word) GROUP BY ALL)
SELECT doc_id, para_no, coalesce('[' || letter || ']', {lit(fixed.DEFAULT_LABEL)}) AS label
FROM paras LEFT JOIN hits USING (doc_id, para_no)"""

ORACLES["sentence_chunks"] = f"""WITH RECURSIVE split AS (SELECT doc_id AS key,
  {sentence_list('text')} AS ss FROM documents), {windows(fixed.MAX_TOKENS)}
SELECT key AS doc_id, piece_no::INTEGER AS piece_no, body FROM windows"""

ORACLES["hybrid_chunks"] = f"""WITH RECURSIVE {DOCS}, {HYBRID}
SELECT doc_id, para_no, piece_no::INTEGER AS piece_no, label, content FROM pieces"""

ORACLES["hash_embeddings"] = f"""WITH {embedded('vectors', 'documents', 'doc_id', 'text')}
SELECT key AS doc_id, component, round(x::FLOAT::DOUBLE, 6) AS v FROM vectors_parts WHERE x <> 0"""

ORACLES["vector_distances"] = """WITH pairs AS (SELECT a.vec_id AS qid,
  list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
  list_transform(a.embedding::DOUBLE[], lambda x: x * 2) AS doubled,
  b.embedding::DOUBLE[] AS other
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
normed AS (SELECT *, sqrt(list_sum(list_transform(doubled, lambda x: x * x))) AS norm FROM pairs)
SELECT qid, round(d, 6) AS d, round(1 / (1 + d), 6) AS score,
  round(list_distance(list_transform(doubled, lambda x: x / norm), other), 6) AS d_unit
FROM normed"""

ORACLES["candidate_topk"] = f"""WITH {VECTORS}, {candidates(fixed.CANDIDATE_K)}
SELECT qid, chunk_id, source_id, d, round(score, 6) AS score, rank FROM hits"""

ORACLES["group_scores"] = f"""WITH {VECTORS}, {candidates(fixed.CANDIDATE_K)}, {SCORES}
SELECT qid, source_id, round(score, 6) AS score, best_rank, group_rank FROM scores"""

ORACLES["group_chunks_topk"] = f"""WITH {VECTORS}, scores AS (
  SELECT id AS qid, source_id, 1 AS group_rank, 1.0 AS score FROM chunks
  WHERE source_id IS NOT NULL), {inside(1, fixed.TOP_K)}
SELECT qid, source_id, chunk_id, d, rank FROM inside"""

ORACLES["ticket_lookup_lateral"] = ORACLES["group_chunks_topk"]

ORACLES["two_stage_retrieval"] = f"WITH {VECTORS}, {retrieval()} {RETRIEVED}"

ORACLES["text_retrieval"] = f"""WITH {TURNS}, {QUESTIONS}, {DOCUMENT_CHUNKS}, {ASKED},
{retrieval()} {RETRIEVED}"""

ORACLES["ann_exact"] = f"""WITH {VECTORS}, {candidates(fixed.TOP_K)}
SELECT qid, chunk_id, source_id, d, rank FROM hits"""

ORACLES["ann_bounded"] = ORACLES["candidate_topk"]

ORACLES["candidate_topk_codes"] = ORACLES["candidate_topk"]

ORACLES["two_stage_ann"] = ORACLES["two_stage_retrieval"]

PROBED = f"""centres AS (SELECT row_number() OVER (ORDER BY label) AS cell, c FROM (
  SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS c FROM embeddings GROUP BY label)),
near_cells AS MATERIALIZED (SELECT qid, cell, row_number() OVER (
    PARTITION BY qid ORDER BY list_distance(v, c), cell) AS near FROM asked, centres),
few AS (SELECT qid, chunk_id, source_id, d, row_number() OVER (
    PARTITION BY qid ORDER BY d, chunk_id)::INTEGER AS rank FROM (
  SELECT a.qid, c.id AS chunk_id, c.source_id, round(list_distance(a.v, c.v), 9) AS d
  FROM near_cells p JOIN near_cells own ON own.cell = p.cell AND own.near = 1
  JOIN asked a ON a.qid = p.qid JOIN chunks c ON c.id = own.qid WHERE p.near <= {ANN_PROBES})
  QUALIFY rank <= {fixed.TOP_K})"""
ORACLES["ann_few_probes"] = f"""WITH {VECTORS}, {PROBED}
SELECT qid, chunk_id, source_id, d, rank FROM few"""

ORACLES["ann_recall"] = f"""WITH {VECTORS}, {candidates(fixed.TOP_K)}, {PROBED}
SELECT hits.qid, count(few.qid) / count(*) AS recall FROM hits
LEFT JOIN few ON few.qid = hits.qid AND few.chunk_id = hits.chunk_id GROUP BY hits.qid"""

ORACLES["context_blocks"] = f"""WITH {TURNS}, {QUESTIONS}, {DOCUMENT_CHUNKS}, {ASKED},
{retrieval(3)},
{contexts(fixed.MODEL_MAX_CONTEXT)} SELECT qid, rank, block FROM blocks"""

ORACLES["context_pack"] = f"""WITH {TURNS}, {QUESTIONS}, {DOCUMENT_CHUNKS}, {ASKED},
{retrieval()},
{contexts(fixed.MODEL_MAX_CONTEXT)} SELECT qid, context FROM contexts"""

ORACLES["context_pack_wide"] = f"""WITH {TURNS}, {QUESTIONS}, {DOCUMENT_CHUNKS}, {ASKED},
{retrieval()},
{contexts(WIDE_CONTEXT)} SELECT qid, context FROM contexts"""

_HEADER, _LIMIT = lit(fixed.CONTEXT_HEADER), JOINED_CONTEXT - fixed.RESERVE_FOR_ANSWER
ORACLES["context_pack_joined"] = f"""WITH RECURSIVE {TURNS}, {QUESTIONS}, {DOCUMENT_CHUNKS}, {ASKED},
{candidates(fixed.CANDIDATE_K)}, {SCORES}, {inside(JOINED_GROUPS, fixed.TOP_K)},
{contexts(JOINED_CONTEXT).replace('contexts AS', 'summed AS')},
fold AS (SELECT qid, rank, block AS body FROM blocks WHERE rank = 1
  UNION ALL SELECT b.qid, b.rank, f.body || {lit(fixed.BLOCK_SEPARATOR)} || b.block
  FROM fold f JOIN blocks b ON b.qid = f.qid AND b.rank = f.rank + 1
  WHERE ({n_tokens(f"({_HEADER} || f.body)")} + 1) // 2 <= {_LIMIT})
SELECT qid, coalesce(arg_max(body, rank) FILTER (
  WHERE ({n_tokens(f"({_HEADER} || body)")} + 1) // 2 <= {_LIMIT}), '') AS context
FROM fold GROUP BY qid"""

_SEP = lit(fixed.CHUNK_SEPARATOR)
ORACLES["sentence_pack"] = f"""WITH {_SENTENCES},
costs AS (SELECT *, sum({n_tokens('sentence')}
    + CASE WHEN sent_no > 1 THEN {n_tokens(_SEP)} ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY sent_no) AS used FROM sentences)
SELECT doc_id, coalesce(string_agg(sentence, {_SEP} ORDER BY sent_no)
  FILTER (WHERE used <= 100 - {n_tokens(lit('Text:' + chr(10)))}), '') AS packed
FROM costs GROUP BY doc_id"""

ORACLES["prompt_rows"] = f"""WITH {TURNS}, {QUESTIONS}, {TURN_CONTEXTS}, {ROUTED}
SELECT qid, prompt, reply FROM routed"""

ORACLES["chat_requests"] = f"""WITH {TURNS}, {QUESTIONS}, {TURN_CONTEXTS}, {ROUTED}
SELECT qid, {REQUEST} AS request FROM routed WHERE prompt IS NOT NULL"""

_STOPS = "|".join(f"\\Q{s}\\E" for s in [*fixed.STOP_SEQUENCES, "tion"]).replace("\n", "\\E\\n\\Q")
ORACLES["response_audit"] = f"""WITH {TURNS},
context_rows AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS context
  FROM turns WHERE role = 'user' GROUP BY conv_id),
contents AS (SELECT turn_id AS qid, context, {lit(' ' + fixed.ANSWER_CAPTION + ' ')} || text
    || {lit(chr(10) + fixed.QUOTE_CAPTION + ' "')}
    || replace(replace(regexp_extract(text, '^[^.]*[.]?'), '"', ''), chr(10), '') || '"' || chr(10) AS content
  FROM turns JOIN context_rows USING (conv_id) WHERE role = 'assistant'),
replies AS (SELECT qid, context,
  {strip(f"string_split_regex(content, '{_STOPS}')[1]")} AS reply FROM contents),
cut AS (SELECT *, strpos(reply, {lit(fixed.QUOTE_CAPTION)}) AS quote_at FROM replies),
parts AS (SELECT qid, context, reply,
    CASE WHEN quote_at > 0 THEN substr(reply, 1, quote_at - 1) ELSE reply END AS head,
    CASE WHEN quote_at > 0 THEN {strip(f'substr(reply, quote_at + {len(fixed.QUOTE_CAPTION)})')} END AS tail
  FROM cut),
parsed AS (SELECT qid, context, reply, {strip(f'''CASE
      WHEN strpos(head, {lit(fixed.ANSWER_CAPTION)}) > 0
      THEN substr(head, strpos(head, {lit(fixed.ANSWER_CAPTION)}) + {len(fixed.ANSWER_CAPTION)})
      ELSE head END''')} AS answer,
    nullif(regexp_extract(tail, '(?s)^"(.*)"', 1), '') AS quote FROM parts)
SELECT qid, reply, answer, quote, len({sentence_list('answer')}) AS n_sentences,
  len({sentence_list('answer')}) BETWEEN 2 AND 5 AS length_ok,
  coalesce(contains(context, quote), false) AS quote_found,
  answer = {lit(fixed.DECLINED_REPLY)} AS declined FROM parsed"""



def answered(max_context: int) -> str:
    """From `pieces` and `questions` to contexts, replies and requests."""
    return f"""{NUMBERED}, contents AS (SELECT id, content FROM numbered),
{embedded('content_vectors', 'numbered', 'id', 'content')},
chunks AS MATERIALIZED (SELECT id, source_id, v FROM numbered JOIN content_vectors ON key = id),
{ASKED}, {retrieval()}, {contexts(max_context)}, {ROUTED}
SELECT qid, context, reply, CASE WHEN prompt IS NOT NULL THEN {REQUEST} END AS request FROM routed"""


ORACLES["answer_pipeline"] = f"""WITH RECURSIVE {CONVERSATIONS}, {QUESTIONS}, {HYBRID},
{answered(PIPELINE_CONTEXT)}"""

ORACLES["ticket_answers"] = f"""WITH RECURSIVE {TICKET_ROWS}, docs AS ({TICKET_TEXT}), {TURNS},
{QUESTIONS}, {hybrid(fixed.TOPICS, fixed.MAX_TOKENS)}, {answered(PIPELINE_CONTEXT)}"""

ORACLES["question_stream_answers"] = f"""WITH {TURNS}, {QUESTIONS}, {DOCUMENT_CHUNKS}, {ASKED},
{retrieval()}, {contexts(WIDE_CONTEXT)}, {ROUTED} SELECT qid, prompt, reply FROM routed"""

ORACLES["question_stream_cells"] = ORACLES["question_stream_answers"]

ORACLES["answer_cells"] = ORACLES["answer_pipeline"]
