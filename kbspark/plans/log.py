"""Registered filters, joins and windows over the log and the base, with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import filters as L
from kbspark.operators import joins as J
from kbspark.plans.analytics import M, T
from kbspark.plans.fixtures import AGENT, AS_OF, projection, table, with_projections

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, tables: str, sql: str | None = None):
    """Registers f(*frames) for projections and plain tables alike."""
    from kbspark.plans.fixtures import PROJECTIONS

    def register(f):
        def run(spark, folder):
            return f(*(projection(spark, folder, t) if t in PROJECTIONS else table(spark, folder, t) for t in tables.split()))

        QUERIES[name] = run
        if sql:
            own = " ".join(t for t in tables.split() if t in PROJECTIONS)
            ORACLES[name] = with_projections(own, sql) if own else ("WITH " + sql.strip()[1:] if sql.strip().startswith(",") else sql)
        return f

    return register


query("f1_filter_questions", "questions", f"""
SELECT id, question, created_at FROM questions WHERE NOT coalesce({M}, false) AND lower(question) LIKE '%item 4%' AND detected_language <> '' AND detected_language <> 'en' ORDER BY created_at DESC, id DESC LIMIT 50""")(
    lambda q: L.filter_questions(q, matched=False, language="non_en", contains="item 4").select("id", "question", "created_at")
)
query("f2_filter_knowledge", "knowledge", "SELECT id, keyword, hits FROM knowledge WHERE status = 'active' AND keyword LIKE 'c%' AND (lower(coalesce(sub_keyword, '') || '|' || question || '|' || response || '|' || keyword) LIKE '%blue%')")(
    lambda k: L.filter_knowledge(k, "active", "c", "blue", "hits").select("id", "keyword", "hits")
)
query("f3_servable_entries", "knowledge", "SELECT id FROM knowledge WHERE status = 'active' AND (expires_at IS NULL OR expires_at > DATE '2024-01-31') AND trim(regexp_replace(response, '<[^>]*>', '', 'g')) <> ''")(lambda k: L.servable_entries(k, AS_OF).select("id"))
query("f4_inquiry_queue", "inquiries", "SELECT id, status FROM inquiries ORDER BY (status <> 'pending'), created_at DESC, id LIMIT 100")(lambda i: L.inquiry_queue(i).select("id", "status"))
query("f5_lead_search", "customer", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey::VARCHAR = '7' AND contains(lower(c_name), '00')")(
    lambda c: L.lead_search(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("identity"), F.lit("").alias("email")), "7", "00").select("id", "name")
)
query("f6_drop_bot_traffic", "events", f"SELECT event_id FROM events WHERE ({AGENT}) <> '' AND NOT regexp_matches(lower({AGENT}), 'bot|curl|crawl|spider|slurp')")(lambda e: e.where(~L.is_bot(F.expr(AGENT))).select("event_id"))
_FORWARDED = "CASE event_id % 4 WHEN 0 THEN concat('10.0.', user_id % 256, '.1, 8.8.8.8') WHEN 1 THEN 'unknown' WHEN 2 THEN '300.1.1.1' END"
query("f7_client_ip", "events", f"""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('10.0.', user_id % 256, '.1') ELSE CASE WHEN event_id % 7 = 0 THEN '1.2.3.4' ELSE '127.0.0.1' END END AS ip FROM events""")(
    lambda e: e.select("event_id", L.client_ip(F.lit(None).cast("string"), F.expr(_FORWARDED), F.expr("case when event_id % 7 = 0 then '1.2.3.4' end"), F.lit("")).alias("ip"))
)
_SOURCES = "SELECT event_id AS id, 'indexed' AS status, CASE event_id % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'never' END AS refresh_interval, CASE WHEN event_id % 50 > 0 THEN ts END AS last_crawled_at FROM events"
query("f8_crawl_due", "events", f"""
, s AS ({_SOURCES}), r AS (SELECT *, row_number() OVER (PARTITION BY refresh_interval ORDER BY last_crawled_at NULLS FIRST, id)::INTEGER AS place FROM s
  WHERE refresh_interval <> 'never' AND (last_crawled_at IS NULL OR last_crawled_at < {T} - to_days(CASE refresh_interval WHEN 'daily' THEN 1 WHEN 'weekly' THEN 7 ELSE 30 END)))
SELECT id, refresh_interval, place FROM r WHERE place <= 10""")(
    lambda e: L.crawl_due(e.selectExpr("event_id as id", "'indexed' as status", "case event_id % 4 when 0 then 'daily' when 1 then 'weekly' when 2 then 'monthly' else 'never' end as refresh_interval", "case when event_id % 50 > 0 then ts end as last_crawled_at"), AS_OF).select("id", "refresh_interval", "place")
)
query("f9_trial_status", "orders", """
, d AS (SELECT o_orderkey AS id, floor((epoch(o_orderdate::TIMESTAMP) - epoch(TIMESTAMP '1998-06-01 00:00:00')) / 86400)::BIGINT AS days_remaining FROM orders WHERE o_orderstatus = 'O')
SELECT *, CASE WHEN days_remaining < -3 THEN 'suspended' WHEN days_remaining < 0 THEN 'grace' WHEN days_remaining <= 1 THEN 'warn_1d' WHEN days_remaining <= 7 THEN 'warn_7d' ELSE 'active' END AS state FROM d""")(
    lambda o: L.trial_status(o.selectExpr("o_orderkey as id", "if(o_orderstatus = 'O', 'trial', 'paid') as status", "cast(o_orderdate as timestamp) as trial_end"), "1998-06-01 00:00:00").select("id", "days_remaining", "state")
)
query("f11_faq_list", "knowledge categories", """
SELECT k.id, hits FROM knowledge k JOIN categories c ON c.id = k.category_id WHERE c.name = 'AMERICA' OR c.name = (SELECT min(name) FROM categories WHERE id = 1) AND k.status = 'active' AND (expires_at IS NULL OR expires_at > DATE '2024-01-31') ORDER BY hits DESC, k.id LIMIT 20""")(
    lambda k, c: L.faq_list(k, c, c.where("id = 1").agg(F.min("name")).first()[0], AS_OF).select("id", "hits")
)
query("f12_category_tree", "categories", """
SELECT c.id, CASE WHEN p.id IS NULL THEN 0 ELSE 1 END AS depth, CASE WHEN p.id IS NULL THEN c.name ELSE p.name || '/' || c.name END AS path FROM categories c LEFT JOIN categories p ON p.id = c.parent_id""")(L.category_tree)

query("j1_recent_questions_with_entry", "questions knowledge", """
SELECT q.id, q.question, q.knowledge_id, k.keyword, k.question AS entry_question FROM (SELECT * FROM questions ORDER BY created_at DESC, id DESC LIMIT 20) q LEFT JOIN knowledge k ON k.id = q.knowledge_id""")(J.recent_questions_with_entry)
_ANSWERS = "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_id + 1 END AS logged_question_id, ts AS created_at FROM events WHERE event_type = 'error'"
query("j3_answer_served", "events", f"""
, q AS (SELECT event_id AS id, ts AS created_at FROM events WHERE event_type <> 'error'), a AS ({_ANSWERS}),
l AS (SELECT logged_question_id AS id, min(id) AS linked FROM a WHERE logged_question_id IS NOT NULL GROUP BY 1),
n AS (SELECT q.id, a.id AS answer_id, row_number() OVER (PARTITION BY q.id ORDER BY abs(floor(epoch(a.created_at)) - floor(epoch(q.created_at))), a.id) AS r FROM q JOIN a ON a.logged_question_id IS NULL AND abs(floor(epoch(a.created_at)) - floor(epoch(q.created_at))) <= 30)
SELECT q.id, coalesce(l.linked, n.answer_id) AS answer_id FROM q LEFT JOIN l ON l.id = q.id LEFT JOIN n ON n.id = q.id AND n.r = 1""")(
    lambda e: J.answer_served(e.where("event_type <> 'error'").selectExpr("event_id as id", "ts as created_at"), e.where("event_type = 'error'").selectExpr("event_id as id", "case when event_id % 3 = 0 then event_id + 1 end as logged_question_id", "ts as created_at"))
)
query("j4_tiebreak_lookup", "questions knowledge", "SELECT id, keyword, sub_keyword, question FROM knowledge WHERE id IN (SELECT knowledge_id FROM questions WHERE ai_tiebreak = 1 UNION SELECT knowledge_id + 7 FROM questions WHERE ai_tiebreak = 1)")(
    lambda q, k: J.tiebreak_lookup(q.where("ai_tiebreak = 1").selectExpr("concat(knowledge_id, ', ', knowledge_id + 7) as tied_ids"), k)
)
_REUSE = "CASE WHEN id % 20 = 3 THEN 1 ELSE 0 END AS reuse_response, CASE WHEN id % 40 = 3 THEN 'nothing' ELSE keyword END AS reuse_keyword, 'aadefault' AS reuse_sub_keyword"
_REUSED = lambda k: k.selectExpr("*", *(x.strip() for x in ("case when id % 20 = 3 then 1 else 0 end as reuse_response", "case when id % 40 = 3 then 'nothing' else keyword end as reuse_keyword", "'aadefault' as reuse_sub_keyword")))
query("j5_orphan_reuse", "knowledge", f"""
, e AS (SELECT *, {_REUSE} FROM knowledge WHERE status = 'active')
SELECT id, reuse_keyword FROM e WHERE reuse_response = 1 AND NOT EXISTS (SELECT 1 FROM e t WHERE lower(t.keyword) = lower(e.reuse_keyword) AND coalesce(t.sub_keyword, '') = e.reuse_sub_keyword)""")(lambda k: J.orphan_reuse(_REUSED(k)).select("id", "reuse_keyword"))
query("j6_resolve_reuse", "knowledge", f"""
, e AS (SELECT *, {_REUSE} FROM knowledge), t AS (SELECT keyword, min(id) AS tid, arg_min(response, id) AS tr FROM e WHERE status = 'active' AND coalesce(nullif(sub_keyword, ''), 'aadefault') = 'aadefault' GROUP BY 1)
SELECT id, CASE WHEN reuse_response = 1 AND tid IS NOT NULL THEN tr ELSE response END AS response, CASE WHEN reuse_response = 1 THEN tid END AS reused_from FROM e LEFT JOIN t ON t.keyword = e.reuse_keyword""")(lambda k: J.resolve_reuse(_REUSED(k)).select("id", "response", "reused_from"))
query("j7_orphan_queue_rows", "vector_chunks chunks", "SELECT content_id FROM vector_chunks WHERE content_type = 'chunk' AND content_id NOT IN (SELECT id FROM chunks WHERE lang = 'en')")(lambda v, c: J.orphan_rows(v.where("content_type = 'chunk'"), c.where("lang = 'en'"), "content_id").select("content_id"))
query("j8_slowest_requests", "request_metrics questions", "SELECT m.id, m.question_id, total_ms, question FROM (SELECT * FROM request_metrics ORDER BY total_ms DESC, id LIMIT 20) m LEFT JOIN questions q ON q.id = m.question_id")(J.slowest_requests)
query("j8_fastest_requests", "request_metrics questions", "SELECT m.id, m.question_id, total_ms, question FROM (SELECT * FROM request_metrics ORDER BY total_ms, id LIMIT 20) m LEFT JOIN questions q ON q.id = m.question_id")(lambda m, q: J.slowest_requests(m, q, fastest=True))
_CITED = "SELECT l_orderkey AS answer_id, l_partkey AS source_id, l_linenumber AS position, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS used_in_answer, CAST(l_quantity AS INT) AS overlap_score FROM lineitem"
query("j9_citations_for_answer", "lineitem", f"""
, a AS ({_CITED}), u AS (SELECT *, max(used_in_answer) OVER (PARTITION BY answer_id) AS used FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY CASE WHEN used = 1 THEN -overlap_score ELSE 0 END, position, source_id)::INTEGER AS place FROM u WHERE used_in_answer = 1 OR used = 0)
SELECT answer_id, source_id, place FROM r WHERE place <= 3""")(
    lambda l: J.citations_for_answer(l.selectExpr("l_orderkey as answer_id", "l_partkey as source_id", "l_linenumber as position", "if(l_quantity > 25, 1, 0) as used_in_answer", "cast(l_quantity as int) as overlap_score")).select("answer_id", "source_id", "place")
)
query("j10_variation_with_entry", "questions knowledge", "SELECT q.id, k.keyword FROM questions q JOIN knowledge k ON k.id = q.knowledge_id WHERE k.status = 'active'")(lambda q, k: q.select("id", "knowledge_id").join(k.where("status = 'active'").select(F.col("id").alias("knowledge_id"), "keyword"), "knowledge_id").select("id", "keyword"))
query("j11_sibling_variations", "knowledge", "SELECT keyword, id AS knowledge_id, 1::BIGINT AS own, (count(*) OVER (PARTITION BY keyword) - 1)::BIGINT AS siblings FROM knowledge WHERE coalesce(sub_keyword, '') NOT IN ('', 'aadefault')")(
    lambda k: J.sibling_variation_counts(k.where("coalesce(sub_keyword, '') not in ('', 'aadefault')").select("keyword", F.col("id").alias("knowledge_id")))
)
query("n4_cap_per_keyword", "knowledge", """
, a AS (SELECT id, keyword, hits, row_number() OVER (PARTITION BY keyword ORDER BY hits DESC, id) AS r FROM knowledge)
SELECT id, keyword, hits FROM a WHERE r <= 2 ORDER BY hits DESC, id LIMIT 5""")(lambda k: J.top_per_group(k.select("id", "keyword", "hits"), ["keyword"], [F.desc("hits"), "id"], 2).orderBy(F.desc("hits"), "id").limit(5))
query("n3_tied_top_matches", "lineitem", """
, m AS (SELECT l_orderkey AS question_id, l_partkey AS id, CAST(l_quantity AS INT) % 10 * 50 AS score FROM lineitem), t AS (SELECT question_id, max(score) AS score FROM m GROUP BY 1)
SELECT t.question_id, t.score, list_sort(list(DISTINCT id)) AS tied FROM m JOIN t ON t.question_id = m.question_id AND t.score = m.score WHERE t.score >= 100 GROUP BY 1, 2 HAVING count(DISTINCT id) >= 2""")(
    lambda l: J.tied_top(l.selectExpr("l_orderkey as question_id", "l_partkey as id", "cast(l_quantity as int) % 10 * 50 as score"))
)
query("n5_eval_run_delta", "orders", """
, r AS (SELECT o_orderdate AS saved_at, min(o_orderkey) AS run_id, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall FROM orders GROUP BY 1)
SELECT *, round(recall - lag(recall) OVER (ORDER BY saved_at, run_id), 4) AS delta FROM r""")(
    lambda o: J.run_deltas(o.groupBy(F.col("o_orderdate").alias("saved_at")).agg(F.min("o_orderkey").alias("run_id"), F.round(F.avg(F.expr("if(o_orderstatus = 'F', 1.0D, 0.0D)")), 4).alias("recall")))
)
query("n7_first_chunk_per_source", "lineitem", """
, f AS (SELECT l_orderkey AS answer_id, l_suppkey AS source_id, l_linenumber AS position, l_partkey AS chunk_id, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem)
SELECT answer_id, source_id, chunk_id, row_number() OVER (PARTITION BY answer_id ORDER BY position, chunk_id, source_id)::INTEGER AS position FROM f WHERE r = 1""")(
    lambda l: J.first_per_source(l.selectExpr("l_orderkey as answer_id", "l_suppkey as source_id", "l_linenumber as position", "l_partkey as chunk_id"))
)
query("n8_latest_user_turn", "conversations", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1")(lambda c: J.latest_turns(c, "user"))
query("o1_set_operations", "questions knowledge", """
(SELECT matched_keyword AS keyword FROM questions WHERE matched_keyword IS NOT NULL INTERSECT SELECT keyword FROM knowledge) UNION (SELECT keyword FROM knowledge EXCEPT SELECT matched_keyword FROM questions)""")(
    lambda q, k: (lambda a, b: a.intersect(b).union(b.subtract(a)).distinct())(q.where("matched_keyword is not null").select(F.col("matched_keyword").alias("keyword")), k.select("keyword"))
)
