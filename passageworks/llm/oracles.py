"""SQL counterparts of the registered queries, where SQL can express them.

The others rest on 64-bit hashes, alignment, tiling, tokenizers, fitted models or
hundreds of Java regexes; `tests/llm` holds them against brute force.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {
    # Base32 of SHA-1: ten hex digits are eight letters.
    "op10_warc_packages": """WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
firsts AS (SELECT s, min(page_id) AS first_id FROM payloads GROUP BY s)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(s, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM payloads JOIN firsts USING (s)""",
    "op12_lexical_search": r"""WITH words AS (SELECT doc_id, row_number() OVER () AS row,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
docs AS MATERIALIZED (SELECT doc_id, row, ws, len(ws)::BIGINT AS n FROM words WHERE len(ws) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS l FROM docs),
wanted AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
hits AS MATERIALIZED (SELECT row, term, count(*)::BIGINT AS tf
  FROM (SELECT row, unnest(ws) AS term FROM docs) SEMI JOIN wanted USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM hits GROUP BY term), totals),
worth AS MATERIALIZED (SELECT row, doc_id, term,
  w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // l))) AS v
  FROM hits JOIN weights USING (term) JOIN docs USING (row), totals),
scores AS (SELECT item_id, row, doc_id, sum(v)::BIGINT AS score
  FROM worth JOIN wanted USING (term) GROUP BY ALL HAVING sum(v) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
  doc_id, score FROM scores QUALIFY rank <= 50""",
}
