"""Common table expressions in DuckDB SQL that the oracles share; unused ones cost nothing."""

TOKENS = r"'[a-z0-9]+'"

TEXT = rf"""
versions0 AS (
  SELECT doc_id AS card_id, source AS line, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS committed_at,
         lag(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS supersedes_id FROM documents),
versions AS (
  SELECT v.*, s.superseded_at FROM versions0 v LEFT JOIN
    (SELECT supersedes_id AS card_id, min(committed_at) AS superseded_at FROM versions0 WHERE supersedes_id IS NOT NULL GROUP BY 1) s USING (card_id)),
queries AS (
  SELECT item_id AS query_id, text AS qtext, TIMESTAMP '2024-01-01' + to_hours(n * (5 + item_id % 5) // 10) AS as_of,
         CASE WHEN item_id % 2 = 0 THEN 'current' ELSE 'history' END AS intent
  FROM benchmark, (SELECT count(*) AS n FROM documents)),
labels AS (
  SELECT query_id, card_id, 2.0::DOUBLE AS grade, row_number() OVER (PARTITION BY query_id ORDER BY card_id) % 3 AS slot
  FROM queries q JOIN documents d ON contains(d.text, q.qtext) JOIN versions v ON v.card_id = d.doc_id AND v.committed_at <= q.as_of),
terms AS (SELECT query_id, unnest(regexp_extract_all(lower(qtext), {TOKENS})) AS term FROM queries),
toks AS (SELECT doc_id AS card_id, regexp_extract_all(lower(text), {TOKENS}) AS w FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM toks),
postings AS (
  SELECT card_id, dl, term, count(*) AS tf FROM (SELECT card_id, len(w) AS dl, unnest(w) AS term FROM toks)
  WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
idf AS (
  SELECT term, count(*) AS df, ln(1.0::DOUBLE + (any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf
  FROM postings, stats GROUP BY term),
bm25 AS (
  SELECT query_id, card_id,
         round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM terms JOIN postings USING (term) JOIN idf USING (term), stats GROUP BY 1, 2),
dense AS (
  SELECT q.vec_id AS query_id, e.vec_id AS card_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN queries ON q.vec_id = query_id, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)),
lex_seen AS (
  SELECT b.*, as_of, intent, committed_at, superseded_at FROM bm25 b JOIN queries USING (query_id) JOIN versions USING (card_id)
  WHERE committed_at <= as_of AND score > 0),
dense_seen AS (
  SELECT b.*, as_of, intent, committed_at, superseded_at FROM dense b JOIN queries USING (query_id) JOIN versions USING (card_id)
  WHERE committed_at <= as_of),
lex_all AS (SELECT query_id, card_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM lex_seen),
dense_all AS (SELECT query_id, card_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM dense_seen),
lex_pool AS (
  SELECT query_id, card_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM lex_seen
  WHERE intent <> 'current' OR superseded_at IS NULL OR superseded_at > as_of),
dense_pool AS (
  SELECT query_id, card_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM dense_seen
  WHERE intent <> 'current' OR superseded_at IS NULL OR superseded_at > as_of),
rrf100 AS (
  SELECT query_id, card_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 8) AS score
  FROM (SELECT * FROM lex_all WHERE rank <= 100 UNION ALL SELECT * FROM dense_all WHERE rank <= 100) GROUP BY 1, 2),
rrf150 AS (
  SELECT query_id, card_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 8) AS score
  FROM (SELECT * FROM lex_all WHERE rank <= 150 UNION ALL SELECT * FROM dense_all WHERE rank <= 150) GROUP BY 1, 2),
first_scores AS (
  SELECT query_id, card_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 8) AS score
  FROM (SELECT * FROM lex_pool WHERE rank <= 150 UNION ALL SELECT * FROM dense_pool WHERE rank <= 150) GROUP BY 1, 2),
first_stage AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM first_scores),
fresh_scores AS (
  SELECT query_id, card_id, round(score / (1.0::DOUBLE + 0.0006::DOUBLE * (date_diff('second', committed_at, as_of) / 86400.0::DOUBLE)), 8) AS score
  FROM rrf150 JOIN queries USING (query_id) JOIN versions USING (card_id) WHERE superseded_at IS NULL OR superseded_at > as_of),
fresh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM fresh_scores),
text_edges AS (
  SELECT card_id AS src, dst, committed_at AS valid_from FROM
    (SELECT card_id, committed_at, lag(card_id) OVER (PARTITION BY line ORDER BY card_id) AS dst FROM versions) WHERE dst IS NOT NULL),
boost_scores AS (
  SELECT r.query_id, r.card_id, round(r.score * (1.0::DOUBLE + 0.35::DOUBLE * ln(1 + (SELECT count(*) FROM text_edges e WHERE e.dst = r.card_id AND e.valid_from <= q.as_of))), 8) AS score
  FROM rrf150 r JOIN queries q USING (query_id)),
boost AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM boost_scores),
run_a AS (SELECT query_id, card_id, score, rank FROM lex_all WHERE rank <= 10),
run_b AS (SELECT query_id, card_id, score, rank FROM fresh WHERE rank <= 10),
rankings AS (SELECT 'bm25' AS run, * FROM run_a UNION ALL SELECT 'fresh', * FROM run_b),
pool AS (SELECT DISTINCT query_id, card_id FROM rankings WHERE rank <= 10),
runs AS (SELECT DISTINCT run FROM rankings),
per AS (SELECT run, query_id, n_relevant FROM runs, (SELECT query_id, count(*) AS n_relevant FROM labels GROUP BY 1)),
hits AS (SELECT run, r.query_id, r.card_id, rank, grade, slot FROM rankings r JOIN labels l ON r.query_id = l.query_id AND r.card_id = l.card_id),
ideal AS (
  SELECT query_id, sum(grade / log2(i + 1)) AS ideal FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, card_id) AS i FROM labels) WHERE i <= 10 GROUP BY 1),
condensed AS (
  SELECT run, query_id, card_id, row_number() OVER (PARTITION BY run, query_id ORDER BY rank) AS rank FROM rankings
  SEMI JOIN (SELECT * FROM pool UNION SELECT query_id, card_id FROM labels) k USING (query_id, card_id)),
ndcg AS (
  SELECT p.run, p.query_id, round(coalesce(d.dcg, 0) / ideal, 6) AS ndcg FROM per p JOIN ideal USING (query_id) LEFT JOIN
    (SELECT run, c.query_id, sum(grade / log2(rank + 1)) AS dcg FROM condensed c JOIN labels l ON c.query_id = l.query_id AND c.card_id = l.card_id
     WHERE rank <= 10 GROUP BY 1, 2) d ON d.run = p.run AND d.query_id = p.query_id),
mrr AS (
  SELECT p.run, p.query_id, round(coalesce(1.0::DOUBLE / h.first, 0), 6) AS mrr FROM per p LEFT JOIN
    (SELECT run, query_id, min(rank) AS first FROM hits GROUP BY 1, 2) h ON h.run = p.run AND h.query_id = p.query_id),
deltas AS (
  SELECT CASE WHEN query_id % 2 = 0 THEN 'current' ELSE 'history' END AS label, query_id, b.mrr - a.mrr AS delta
  FROM (SELECT * FROM mrr WHERE run = 'bm25') a JOIN (SELECT * FROM mrr WHERE run = 'fresh') b USING (query_id)),
labelled_deltas AS (SELECT 'all' AS label, query_id, delta FROM deltas UNION ALL SELECT * FROM deltas)
"""


def with_text(select: str) -> str:
    return f"WITH {TEXT.strip()}\n{select.strip()}\n"


ORDERS = r"""
ord0 AS (
  SELECT o_orderkey AS card_id, o_custkey AS line, o_orderdate AS committed_at, o_totalprice AS price,
         lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes_id,
         first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS root FROM orders),
ord AS (
  SELECT o.*, s.superseded_at FROM ord0 o LEFT JOIN
    (SELECT supersedes_id AS card_id, min(committed_at) AS superseded_at FROM ord0 WHERE supersedes_id IS NOT NULL GROUP BY 1) s USING (card_id)),
order_edges AS (
  SELECT DISTINCT src, dst, valid_from FROM (
    SELECT l_orderkey AS src, o_orderdate AS valid_from, lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey) AS dst
    FROM (SELECT DISTINCT l_orderkey, l_partkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
  WHERE dst IS NOT NULL AND dst <> src),
walks AS (SELECT n_nationkey::BIGINT AS query_id, TIMESTAMP '1995-01-01' + to_days(30 * n_nationkey) AS as_of FROM nation),
seeds AS (
  SELECT query_id, card_id, rank FROM (
    SELECT w.query_id, card_id, row_number() OVER (PARTITION BY w.query_id ORDER BY price DESC, card_id) AS rank
    FROM ord JOIN customer ON line = c_custkey JOIN walks w ON w.query_id = c_nationkey WHERE committed_at <= as_of) WHERE rank <= 10),
adjacent AS (
  SELECT a, b, min(valid_from) AS valid_from FROM (
    SELECT s.root AS a, d.root AS b, valid_from FROM order_edges e JOIN ord s ON e.src = s.card_id JOIN ord d ON e.dst = d.card_id
    UNION ALL SELECT d.root, s.root, valid_from FROM order_edges e JOIN ord s ON e.src = s.card_id JOIN ord d ON e.dst = d.card_id)
  WHERE a <> b GROUP BY 1, 2)
"""


def with_orders(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {ORDERS.strip()}{',' + more if more else ''}\n{select.strip()}\n"
