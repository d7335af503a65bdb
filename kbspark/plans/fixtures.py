"""Projections of the driver's tables to the library's schemas, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-01 00:00:00"
#: The user agent of an event.
AGENT = "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' WHEN 2 THEN 'curl/8.0' WHEN 3 THEN 'Mozilla/5.0 Firefox/120.0' ELSE concat('Agent-', event_type) END"

PROJECTIONS = {
    "questions": """
SELECT event_id AS id,
       CASE WHEN event_id % 3 = 0 THEN concat('  ', upper(concat(event_type, ' item ', regexp_extract(props, '[0-9]+', 0))))
            ELSE concat(event_type, ' item ', regexp_extract(props, '[0-9]+', 0)) END AS question,
       CASE WHEN user_id % 7 = 0 THEN 'es' WHEN user_id % 7 = 1 THEN '' WHEN user_id % 7 = 2 THEN NULL ELSE 'en' END AS detected_language,
       CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS matched_keyword,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS bigint) END AS knowledge_id,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL WHEN event_type = 'error' THEN 'none'
            WHEN event_type = 'signup' THEN 'exact' ELSE 'partial' END AS match_type,
       CAST(value AS decimal(5,2)) AS match_score,
       CASE WHEN event_type <> 'error' AND event_id % 11 = 0 THEN 1 ELSE 0 END AS ai_rejected,
       CASE WHEN event_type <> 'error' AND event_id % 17 = 0 THEN 1 ELSE 0 END AS ai_tiebreak,
       CASE WHEN event_id % 11 = 0 OR event_id % 17 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END END AS ai_provider,
       concat('u', user_id) AS ip_address, ts AS created_at
FROM events""",
    "knowledge": """
SELECT p_partkey AS id,
       CASE p_partkey % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'signup' ELSE 'purchase' END AS keyword,
       CASE WHEN p_partkey % 10 = 0 THEN 'aadefault' ELSE concat(split_part(p_name, ' ', 1), '&', split_part(p_name, ' ', 2)) END AS sub_keyword,
       concat('about ', p_name) AS question, concat('<p>', p_name, ' ', p_brand, '</p>') AS response,
       p_partkey % 5 AS category_id,
       CASE WHEN p_size % 9 = 0 THEN 'hold' WHEN p_size % 11 = 0 THEN 'inactive' ELSE 'active' END AS status,
       CAST(p_size * 3 AS int) AS hits, CAST(p_partkey % 13 AS int) AS helpful_yes, CAST(p_partkey % 7 AS int) AS helpful_no,
       CASE WHEN p_size % 6 = 0 THEN CAST('2024-02-03' AS date) WHEN p_size % 10 = 1 THEN CAST('2023-12-31' AS date) END AS expires_at
FROM part""",
    "match_kb": """
SELECT min(p_partkey) AS id, split_part(p_name, ' ', 2) AS keyword, split_part(p_name, ' ', 1) AS sub_keyword,
       concat('about the ', p_name) AS question, concat('<p>See the ', p_name, ' page.</p>') AS response,
       'active' AS status, CAST(sum(p_size) AS bigint) AS hits
FROM part GROUP BY p_name""",
    "match_questions": """
SELECT e.event_id AS id,
       CASE e.event_id % 4 WHEN 0 THEN concat('What is the price of ', p.p_name, 's?')
            WHEN 1 THEN concat('I dont like my ', split_part(p.p_name, ' ', 2), ' it is too ', split_part(p.p_name, ' ', 1))
            WHEN 2 THEN concat(split_part(p.p_name, ' ', 2), ' problem') ELSE concat('hello ', e.event_type) END AS question,
       p.p_partkey AS true_part, e.ts AS created_at
FROM (SELECT event_id, event_type, ts, event_id % (SELECT max(p_partkey) FROM part) + 1 AS part_no FROM events) e JOIN part p ON p.p_partkey = e.part_no""",
    "visitors": """
SELECT concat('u', e.user_id) AS ip_address, CASE WHEN n.n_regionkey = 1 THEN 'US' ELSE concat('C', n.n_regionkey) END AS country_code,
       r.r_name AS country_name, n.n_name AS region, concat(n.n_name, '-', e.user_id % 3) AS city,
       count(*) AS visit_count, min(e.ts) AS first_visit, max(e.ts) AS last_visit
FROM events e JOIN customer c ON c.c_custkey = e.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY e.user_id, n.n_regionkey, r.r_name, n.n_name""",
    "request_metrics": """
SELECT event_id AS id, event_id AS question_id, CAST(floor(value * 100) AS int) AS total_ms, CAST(floor(value * 10) AS int) AS kb_ms,
       CASE WHEN event_type IN ('error','view') THEN CAST(floor(value * 20) AS int) END AS retrieval_ms,
       CASE WHEN event_type = 'error' THEN CAST(floor(value * 40) AS int) END AS synthesis_ms,
       CAST(floor(value * 5) AS int) AS render_ms,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS ai_fallback_fired, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS cache_hit,
       CASE WHEN event_type IN ('error','view') THEN CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END END AS gate_fired,
       CASE event_type WHEN 'signup' THEN 'kb_strong' WHEN 'purchase' THEN 'kb_strong' WHEN 'error' THEN 'ai_only' WHEN 'view' THEN 'kb_weak_with_ai' ELSE 'no_answer' END AS matched_layer,
       CAST(user_id * 10 AS int) AS tokens_in, CAST(user_id AS int) AS tokens_out, CAST(value / 1000 AS decimal(10,6)) AS cost,
       CASE user_id % 3 WHEN 0 THEN 'm-small' WHEN 1 THEN 'm-large' END AS synthesis_model, ts AS created_at
FROM events""",
    "inquiries": """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'answered' ELSE 'archived' END AS status,
       concat('u', o_custkey) AS ip_address, o_orderpriority AS handoff_type, o_orderdate AS created_at FROM orders""",
    "source_usage": """
SELECT l_partkey AS source_id, l_orderkey AS conversation_id, l_orderkey * 10 + l_linenumber AS ai_answer_id, l_shipdate AS created_at FROM lineitem""",
    "conversation_ratings": """
SELECT o_orderkey AS conversation_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'not_helpful' WHEN '2-HIGH' THEN 'somewhat' ELSE 'helpful' END AS rating,
       o_orderdate AS created_at FROM orders WHERE o_orderkey % 3 = 0""",
    "ratings": """
SELECT doc_id AS knowledge_id, CASE WHEN quality = 1 THEN 'helpful' ELSE 'not_helpful' END AS rating, concat('u', doc_id % 20) AS ip_address FROM labels""",
    "usage": """
SELECT l_suppkey AS tenant_id, l_shipdate AS created_at, CAST(l_quantity * 100 AS bigint) AS input_tokens, CAST(l_quantity * 7 AS bigint) AS output_tokens,
       CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS bigint) ELSE 0 END AS cache_create,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS bigint) ELSE 0 END AS cache_read,
       CASE l_linenumber % 3 WHEN 0 THEN 'm-small' WHEN 1 THEN 'm-large' ELSE 'm-other' END AS model FROM lineitem""",
    "ai_answers": """
SELECT u.conv_id * 1000 + u.turn AS id, u.text AS question, a.text AS answer, u.conv_id AS conversation_id,
       CASE u.conv_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'promoted' ELSE 'rejected' END AS status
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",
    "chunks": """
SELECT doc_id AS id, CAST(substr(source, 4) AS bigint) AS source_id, doc_id AS chunk_index, text AS content, lang FROM documents""",
    "vector_queries": """
SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0""",
    "vector_chunks": """
SELECT vec_id AS content_id, label AS source_id, CASE WHEN vec_id % 7 = 0 THEN 'kb_entry' ELSE 'chunk' END AS content_type,
       CASE WHEN vec_id % 7 = 0 THEN 'kb' WHEN vec_id % 5 = 0 THEN NULL ELSE 'source' END AS source_namespace,
       vec_id % 11 <> 0 AS is_current, 't1' AS tenant_id, embedding FROM embeddings WHERE vec_id % 50 <> 0""",
    "categories": """
SELECT CAST(n_nationkey AS bigint) AS id, n_name AS name, CASE WHEN n_nationkey >= 5 THEN CAST(n_regionkey AS bigint) END AS parent_id FROM nation""",
    "sources": """
SELECT DISTINCT CAST(substr(source, 4) AS bigint) AS id, source AS title, CASE WHEN CAST(substr(source, 4) AS bigint) % 10 = 9 THEN 'error' ELSE 'indexed' END AS status
FROM documents""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def projection(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The named projection over the tables of a folder."""
    sql = PROJECTIONS[name]
    used = {t: table(spark, folder, t) for t in TABLES if f" {t}" in sql}
    for t, df in used.items():
        df.createOrReplaceTempView(t)
    return spark.sql(sql)


def with_projections(names: str, body: str) -> str:
    """body as DuckDB SQL with the named projections before it."""
    # body starts with a comma if it goes on with common table expressions
    return "WITH " + ",\n".join(f"{n} AS ({PROJECTIONS[n]})" for n in names.split()) + "\n" + body.strip()
