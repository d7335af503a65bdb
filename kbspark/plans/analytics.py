"""Registered reports, with independent SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import analytics as A
from kbspark.plans.fixtures import AS_OF, ORDERS_AS_OF, projection, with_projections
from kbspark.sources.tables import written

STOPWORDS = ["the", "and", "item"]
RATES = [("m-small", 0.15, 0.6), ("m-large", 5.0, 25.0)]
M = "match_type IS NOT NULL AND match_type <> 'none'"
D = "DATE '2024-01-31'"
T = "TIMESTAMP '2024-01-31 00:00:00'"

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, tables: str, sql: str | None = None):
    """Registers f(*the named projections) and its SQL over the same projections."""

    def register(f):
        QUERIES[name] = lambda spark, folder: f(*(projection(spark, folder, t) for t in tables.split()))
        if sql:
            ORACLES[name] = with_projections(tables, sql)
        return f

    return register


def rate(a: str, b: str, d: int = 1) -> str:
    return f"CASE WHEN {b} > 0 THEN round(100.0::DOUBLE * {a} / {b}, {d}) ELSE 0.0::DOUBLE END"


STATS = f"""k AS (SELECT count(*) AS total_entries, count(*) FILTER (status = 'active') AS active_entries, count(*) FILTER (status = 'inactive') AS inactive_entries,
  count(*) FILTER (status = 'hold') AS hold_entries, count(*) FILTER (expires_at BETWEEN {D} AND {D} + 7) AS expiring_soon FROM knowledge),
q AS (SELECT count(*) AS total_questions, count(*) FILTER (created_at::DATE = {D}) AS questions_today, count(*) FILTER (created_at >= {T} - INTERVAL 7 DAY) AS questions_7d,
  count(*) FILTER (created_at >= {T} - INTERVAL 30 DAY) AS questions_30d, count(*) FILTER ({M}) AS matched, count(*) - count(*) FILTER ({M}) AS unmatched,
  count(DISTINCT ip_address) AS visitors, count(DISTINCT ip_address) FILTER (created_at >= {T} - INTERVAL 7 DAY) AS visitors_7d FROM questions),
i AS (SELECT count(*) FILTER (status = 'pending') AS pending_inquiries, count(*) AS total_inquiries FROM inquiries),
r AS (SELECT count(*) FILTER (rating = 'helpful') AS helpful, count(*) FILTER (rating = 'not_helpful') AS not_helpful FROM ratings),
s AS (SELECT *, {rate('matched', 'total_questions')} AS match_rate, {rate('helpful', '(helpful + not_helpful)')} AS helpfulness_rate FROM k, q, i, r)"""

query("a1_dashboard_stats", "knowledge questions inquiries ratings", f", {STATS} SELECT * FROM s".lstrip())(lambda k, q, i, r: A.dashboard_stats(k, q, i, r, AS_OF))
query("a2_questions_trend", "questions", f"""
SELECT d::DATE AS day, count(id) AS total, count(id) FILTER ({M}) AS matched, count(id) - count(id) FILTER ({M}) AS unmatched
FROM range({D} - 30, {D} + 1, INTERVAL 1 DAY) t(d) LEFT JOIN questions ON created_at::DATE = d::DATE GROUP BY d""")(lambda q: A.questions_trend(q, AS_OF))
query("a3_match_type_distribution", "questions", f"SELECT match_type, count(*) AS n FROM questions WHERE created_at >= {T} - INTERVAL 30 DAY GROUP BY 1")(lambda q: A.match_type_distribution(q, AS_OF))
query("a4_language_breakdown", "questions", f"""
SELECT CASE WHEN detected_language IS NULL OR detected_language = '' THEN 'en' ELSE detected_language END AS language, count(*) AS n,
  round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 0) AS share FROM questions WHERE created_at >= {T} - INTERVAL 30 DAY GROUP BY 1""")(lambda q: A.language_breakdown(q, AS_OF))
query("a5_top_keywords", "questions knowledge", f"""
SELECT q.matched_keyword, count(*) AS hits, coalesce({rate('max(helpful_yes)', '(max(helpful_yes) + max(helpful_no))', 0)}, 0) AS rating
FROM questions q LEFT JOIN knowledge k ON k.keyword = q.matched_keyword WHERE q.matched_keyword <> '' AND q.created_at >= {T} - INTERVAL 30 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")(lambda q, k: A.top_keywords(q, k, AS_OF))
query("a6_top_entries_by_hits", "knowledge", f"""
SELECT id, question, hits, {rate('helpful_yes', '(helpful_yes + helpful_no)')} AS rating FROM knowledge
WHERE status = 'active' AND (expires_at IS NULL OR expires_at > {D}) AND question <> '' ORDER BY hits DESC, id LIMIT 10""")(lambda k: A.top_entries_by_hits(k, AS_OF))
query("a7_unmatched_questions", "questions", f"""
SELECT lower(trim(question)) AS question_key, count(*) AS n, max(created_at) AS last_asked, arg_min(question, id) AS sample_question
FROM questions WHERE NOT coalesce({M}, false) GROUP BY 1 HAVING count(*) >= 2""")(lambda q: A.unmatched_questions(q, 2))
query("a8_visitor_geography", "visitors", f"""
, c AS (SELECT 'country' AS level, country_code, country_name, NULL::VARCHAR AS region, NULL::VARCHAR AS city, count(*) AS visitors, sum(visit_count)::BIGINT AS visits
  FROM visitors WHERE last_visit >= {T} - INTERVAL 30 DAY GROUP BY 2, 3 ORDER BY 6 DESC, 7 DESC, 2, 3 LIMIT 20),
u AS (SELECT 'region' AS level, country_code, NULL::VARCHAR, region, NULL::VARCHAR, count(*), sum(visit_count)::BIGINT FROM visitors
  WHERE country_code = 'US' AND last_visit >= {T} - INTERVAL 30 DAY GROUP BY 2, 4 ORDER BY 6 DESC, 7 DESC, 4 LIMIT 25),
v AS (SELECT 'city' AS level, country_code, NULL::VARCHAR, region, city, count(*), sum(visit_count)::BIGINT FROM visitors
  WHERE country_code = 'US' AND last_visit >= {T} - INTERVAL 30 DAY GROUP BY 2, 4, 5 ORDER BY 6 DESC, 7 DESC, 4, 5 LIMIT 25)
SELECT * FROM c UNION ALL SELECT * FROM u UNION ALL SELECT * FROM v""")(lambda v: A.visitor_geography(v, AS_OF))
query("a9_hourly_pattern", "questions", f"""
SELECT printf('%02d:00', h) AS label, count(id) AS n FROM range(24) t(h) LEFT JOIN questions ON hour(created_at) = h AND created_at >= {T} - INTERVAL 30 DAY GROUP BY h""")(lambda q: A.hourly_pattern(q, AS_OF))
query("a10_weekday_pattern", "questions", f"""
SELECT w::INTEGER AS weekday, ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][w] AS name, count(id) AS n
FROM range(1, 8) t(w) LEFT JOIN questions ON dayofweek(created_at) + 1 = w AND created_at >= {T} - INTERVAL 30 DAY GROUP BY w""")(lambda q: A.weekday_pattern(q, AS_OF))
query("a11_period_comparison", "questions", f"""
, c AS (SELECT count(*) FILTER (created_at >= {T} - INTERVAL 7 DAY) AS total_now, count(*) FILTER (created_at >= {T} - INTERVAL 14 DAY AND created_at < {T} - INTERVAL 7 DAY) AS total_before,
  count(*) FILTER (created_at >= {T} - INTERVAL 7 DAY AND {M}) AS matched_now, count(*) FILTER (created_at >= {T} - INTERVAL 14 DAY AND created_at < {T} - INTERVAL 7 DAY AND {M}) AS matched_before FROM questions),
r AS (SELECT *, {rate('matched_now', 'total_now')} AS rate_now, {rate('matched_before', 'total_before')} AS rate_before FROM c)
SELECT *, CASE WHEN total_before > 0 THEN round(100.0::DOUBLE * (total_now - total_before) / total_before, 1) ELSE 0 END AS change, round(rate_now - rate_before, 1) AS rate_difference FROM r""")(lambda q: A.period_comparison(q, AS_OF))
query("a12_search_terms", "questions", f"""
, w AS (SELECT unnest(string_split_regex(lower(question), '\\s+')) AS w FROM questions WHERE created_at >= {T} - INTERVAL 30 DAY)
SELECT regexp_replace(w, '[^a-z0-9]', '', 'g') AS term, count(*) AS n FROM w WHERE length(w) > 2 AND w NOT IN ('the','and','item') AND NOT regexp_full_match(w, '[0-9.]+')
GROUP BY 1 HAVING term <> '' ORDER BY 2 DESC, 1 LIMIT 50""")(lambda q: A.search_terms(q, STOPWORDS, AS_OF))
query("a13_entries_needing_attention", "knowledge", f"""
, r AS (SELECT id, hits, helpful_yes + helpful_no AS total, expires_at, {rate('helpful_yes', '(helpful_yes + helpful_no)')} AS rating FROM knowledge WHERE status = 'active'),
b AS (SELECT 'low_rated' AS bucket, id, hits, rating, rating AS o FROM r WHERE hits >= 10 AND total > 0 AND rating < 50
  UNION ALL SELECT 'expiring', id, hits, rating, expires_at - {D} FROM r WHERE expires_at BETWEEN {D} AND {D} + 7
  UNION ALL SELECT 'never_accessed', id, hits, rating, id FROM r WHERE hits = 0
  UNION ALL SELECT 'high_traffic_low_rating', id, hits, rating, -hits FROM r WHERE hits >= 50 AND total > 0 AND rating < 70),
n AS (SELECT bucket, id, hits, rating, row_number() OVER (PARTITION BY bucket ORDER BY o, id)::INTEGER AS place FROM b)
SELECT * FROM n WHERE place <= 10""")(lambda k: A.entries_needing_attention(k, AS_OF))
query("a14_executive_summary", "knowledge questions inquiries ratings", f""", {STATS}
SELECT match_rate, helpfulness_rate, unmatched, concat_ws(',', CASE WHEN match_rate < 70 THEN 'improve_match_rate' END, CASE WHEN pending_inquiries > 10 THEN 'answer_inquiries' END,
  CASE WHEN unmatched > 0 THEN 'add_entries' END, CASE WHEN expiring_soon > 0 THEN 'renew_entries' END, CASE WHEN helpfulness_rate < 80 THEN 'improve_answers' END) AS recommendations FROM s""")(lambda k, q, i, r: A.executive_summary(k, q, i, r, AS_OF))
query("a15_coverage_split", "questions ai_answers", f"""
, c AS (SELECT (SELECT count(*) FROM ai_answers) AS ai, count(*) AS total, count(*) FILTER ({M}) AS kb FROM questions WHERE created_at >= {T} - INTERVAL 30 DAY),
n AS (SELECT total, kb, ai, greatest(0, total - kb - ai) AS none FROM c)
SELECT total, kb, ai, none, round(100.0::DOUBLE * (kb + ai) / total, 0) AS coverage, {rate('kb', 'total')} AS kb_share, {rate('ai', 'total')} AS ai_share, {rate('none', 'total')} AS none_share FROM n""")(lambda q, a: A.coverage_split(q, a, AS_OF))
query("a16_csat", "conversation_ratings", f"""
SELECT count(*) AS total, count(*) FILTER (rating = 'helpful') AS helpful, count(*) FILTER (rating = 'somewhat') AS somewhat, count(*) FILTER (rating = 'not_helpful') AS not_helpful,
  {rate("count(*) FILTER (rating = 'helpful')", 'count(*)')} AS helpful_rate FROM conversation_ratings WHERE created_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY""")(lambda r: A.csat(r, ORDERS_AS_OF))
query("a17_source_effectiveness", "source_usage conversation_ratings", """
SELECT source_id, count(DISTINCT ai_answer_id) AS answers, count(*) FILTER (rating = 'helpful') AS helpful, count(*) FILTER (rating = 'not_helpful') AS not_helpful
FROM source_usage u LEFT JOIN conversation_ratings r ON r.conversation_id = u.conversation_id GROUP BY 1""")(A.source_effectiveness)
query("a18_answers_latest_per_question", "ai_answers", """
SELECT lower(trim(question)) AS question_key, max(id) AS id, count(*) AS ask_count, arg_max(status, id) AS status FROM ai_answers GROUP BY 1 ORDER BY 2 DESC LIMIT 100""")(A.answers_latest_per_question)
query("a19_answer_status_counts", "ai_answers", """
, c AS (SELECT status, count(DISTINCT lower(trim(question))) AS n FROM ai_answers GROUP BY 1)
SELECT status, n FROM c UNION ALL SELECT 'all', sum(n)::BIGINT FROM c""")(A.answer_status_counts)
query("a20_decision_summary", "questions", f"""
, c AS (SELECT count(*) AS total, count(*) FILTER ({M}) AS matched, sum(ai_tiebreak)::BIGINT AS tiebreaks, sum(ai_rejected)::BIGINT AS rejections FROM questions)
SELECT *, {rate('matched', 'total')} AS match_rate, {rate('rejections', 'matched')} AS rejection_rate FROM c""")(A.decision_summary)
query("a21_decisions_by_provider", "questions", """
SELECT ai_provider, count(*) AS n, sum(ai_tiebreak)::BIGINT AS tiebreaks, sum(ai_rejected)::BIGINT AS rejections FROM questions WHERE (ai_tiebreak = 1 OR ai_rejected = 1) AND ai_provider <> '' GROUP BY 1""")(A.decisions_by_provider)
query("a22_top_rejected_entries", "questions knowledge", """
SELECT q.knowledge_id, count(*) AS rejections, any_value(k.keyword) AS keyword, any_value(k.sub_keyword) AS sub_keyword FROM questions q LEFT JOIN knowledge k ON k.id = q.knowledge_id
WHERE ai_rejected = 1 AND q.knowledge_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")(A.top_rejected_entries)
query("a23_keyword_overview", "knowledge", """
SELECT keyword, count(*) AS patterns, count(*) FILTER (status = 'active') AS active, max(question) FILTER (sub_keyword = 'aadefault') AS default_phrase, sum(hits)::BIGINT AS total_hits FROM knowledge GROUP BY 1""")(A.keyword_overview)
query("a24_status_counts", "knowledge", """
SELECT status, count(*) AS entries, count(DISTINCT keyword) AS keywords, count(*) FILTER (coalesce(sub_keyword, '') <> 'aadefault') AS recompilable FROM knowledge GROUP BY 1""")(A.status_counts)


def _p(c: str, p: int, name: str) -> str:
    return f"CAST(floor(quantile_cont({c}, {p / 100}) + 0.5) AS BIGINT) AS {name}"


_STAGES = ("kb_ms", "retrieval_ms", "synthesis_ms", "render_ms")
query("a25_latency_stats", "request_metrics", f"""
SELECT count(*) AS n, sum(cache_hit)::BIGINT AS cache_hits, sum(ai_fallback_fired)::BIGINT AS ai_fired, sum(gate_fired)::BIGINT AS gate_fired, count(gate_fired) AS gate_evaluated,
  sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(cost)::DOUBLE AS cost,
  {', '.join(_p(c, p, f'{c}_p{p}') for c in ('total_ms', *_STAGES) for p in (50, 95))}, {', '.join(f'count({c}) AS {c}_n' for c in _STAGES)} FROM request_metrics""")(lambda m: A.latency_stats(m).withColumn("cost", F.col("cost").cast("double")))
query("a26_latency_by_layer", "request_metrics", f"""
SELECT matched_layer, count(*) AS n, {_p('total_ms', 50, 'p50')}, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS share FROM request_metrics GROUP BY 1""")(lambda m: A.latency_by(m, "matched_layer"))
query("a27_latency_by_model", "request_metrics", f"""
SELECT coalesce(synthesis_model, 'unknown') AS model, count(*) AS n, {_p('synthesis_ms', 50, 'p50')}, {_p('synthesis_ms', 95, 'p95')}, {_p('tokens_out', 50, 'tokens_p50')}, sum(cost)::DOUBLE AS cost
FROM request_metrics WHERE synthesis_ms IS NOT NULL GROUP BY 1""")(lambda m: A.latency_by(m, "model").withColumn("cost", F.col("cost").cast("double")))
query("a28_usage_monthly", "usage", """
SELECT tenant_id, date_trunc('month', created_at)::DATE AS month, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_create)::BIGINT AS cache_create,
  sum(cache_read)::BIGINT AS cache_read, count(*) FILTER (cache_create > 0 OR cache_read > 0) AS cache_calls, count(*) FILTER (cache_read > 0) AS cache_hits FROM usage GROUP BY 1, 2""")(A.usage_monthly)


def _rates(df):
    return df.sparkSession.createDataFrame(RATES, "model string, rate_in double, rate_out double")


_COSTED = """, p(model, i, o) AS (VALUES ('m-small', 1500, 6000), ('m-large', 50000, 250000)),
c AS (SELECT u.*, CAST(((input_tokens * coalesce(i, 1500) * 100 + cache_create * coalesce(i, 1500) * 125 + cache_read * coalesce(i, 1500) * 10 + output_tokens * coalesce(o, 6000) * 100) + 500000) // 1000000 AS DECIMAL(20,6)) / 1000000 AS cost
  FROM usage u LEFT JOIN p ON p.model = u.model)"""
query("a29_token_cost", "usage", _COSTED + " SELECT model, count(*) AS calls, CAST(sum(CAST(cost AS DECIMAL(20,6))) AS DOUBLE) AS cost FROM c GROUP BY 1")(
    lambda u: A.token_cost(u, _rates(u), "m-small").groupBy("model").agg(F.count("*").alias("calls"), F.sum(F.col("cost").cast("decimal(20,6)")).cast("double").alias("cost"))
)
query("a30_tenant_rollup", "usage", """
SELECT tenant_id, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(cache_read)::BIGINT AS cache_read, round(sum(cache_read)::BIGINT / 1e6 * 3 * 0.9::DOUBLE, 6) AS saved
FROM usage GROUP BY GROUPING SETS ((tenant_id), ())""")(A.tenant_rollup)
query("a31_active_tenants", "usage source_usage", "SELECT DISTINCT tenant_id FROM usage WHERE tenant_id IN (SELECT source_id FROM source_usage)")(lambda u, s: u.join(s.select(F.col("source_id").alias("tenant_id")).distinct(), "tenant_id", "left_semi").select("tenant_id").distinct())
query("a32_rating_recount", "knowledge ratings", """
SELECT k.id, count(*) FILTER (rating = 'helpful') AS helpful_yes, count(*) FILTER (rating = 'not_helpful') AS helpful_no FROM knowledge k LEFT JOIN ratings r ON r.knowledge_id = k.id GROUP BY 1""")(A.rating_recount)
query("a33_hits_recount", "knowledge questions", "SELECT k.id, k.hits + count(q.id) AS hits FROM knowledge k LEFT JOIN questions q ON q.knowledge_id = k.id GROUP BY k.id, k.hits")(A.hits_recount)
query("a34_approx_visitors", "questions", "SELECT created_at::DATE AS day, count(DISTINCT ip_address) AS exact, true AS near FROM questions GROUP BY 1")(
    # a sketch is not the number: what is held against SQL is that it is near it, by five of its standard errors
    lambda q: A.approx_visitors(q).join(q.groupBy(F.to_date("created_at").alias("day")).agg(F.count_distinct("ip_address").alias("exact")), "day").select("day", "exact", (F.abs(F.col("visitors") - F.col("exact")) <= 1 + 0.1 * F.col("exact")).alias("near"))
)


def _windows(q):
    """Windows of 7, 30 and 90 days to each day of the log, from one stored table of sketches; beside them the exact numbers."""
    q = q.select("ip_address", F.to_date("created_at").alias("day"), "created_at")
    sketches = written(A.visitor_sketches(q))
    found = A.visitors_in_windows(sketches, sketches.select(F.col("day").alias("end")))
    seen = q.select("ip_address", "day").distinct()
    ends = sketches.select(F.col("day").alias("end")).crossJoin(F.broadcast(q.sparkSession.createDataFrame([(7,), (30,), (90,)], "days int")))  # three rows
    named = ends.select("end", "days", F.explode(F.sequence(F.date_sub("end", F.col("days") - 1), F.col("end"))).alias("day"))
    exact = named.join(seen, "day").groupBy("end", "days").agg(F.count_distinct("ip_address").alias("exact"))
    rows = found.join(exact, ["end", "days"])
    # five standard errors of 2 ** 12 buckets
    return rows.select("end", "days", "questions", "exact", (F.abs(F.col("visitors") - F.col("exact")) <= 0.5 + 5 * 0.01625 * F.col("exact")).alias("near"))


query("a34_visitors_in_windows", "questions", """
, d AS (SELECT created_at::DATE AS day, ip_address FROM questions), e AS (SELECT DISTINCT day AS "end" FROM d)
SELECT "end", n::INTEGER AS days, count(*) AS questions, count(DISTINCT ip_address) AS exact, true AS near
FROM e, (VALUES (7), (30), (90)) w(n) JOIN d ON d.day <= "end" AND d.day > "end" - n::INTEGER GROUP BY 1, 2""")(_windows)
query("a35_category_performance", "knowledge categories", f"""
SELECT c.id AS category_id, c.name, count(*) AS entries, sum(hits)::BIGINT AS hits, round(avg(CASE WHEN helpful_yes + helpful_no > 0 THEN {rate('helpful_yes', '(helpful_yes + helpful_no)')} END), 1) AS rating
FROM knowledge k JOIN categories c ON c.id = k.category_id GROUP BY 1, 2""")(A.category_performance)
query("a36_period_stats", "questions", f"""
, d(days) AS (VALUES (7), (30), (90), (365))
SELECT days, count(*) AS questions, count(DISTINCT ip_address) AS visitors, count(*) FILTER ({M}) AS matched, {rate(f'count(*) FILTER ({M})', 'count(*)')} AS match_rate
FROM d JOIN questions ON created_at >= {T} - to_days(days) GROUP BY 1""")(lambda q: A.period_stats(q, AS_OF))
query("a37_admin_badges", "ai_answers inquiries", """
SELECT (SELECT count(*) FROM ai_answers WHERE status = 'pending') AS pending_answers, (SELECT count(*) FROM inquiries WHERE status = 'pending') AS pending_inquiries""")(
    lambda a, i: a.agg(A._count("status = 'pending'").alias("pending_answers")).crossJoin(i.agg(A._count("status = 'pending'").alias("pending_inquiries")))
)
query("f10_budget_status", "usage", _COSTED + """, m AS (SELECT tenant_id, date_trunc('month', created_at)::DATE AS month, count(*) AS calls, sum(CAST(cost AS DECIMAL(20,6))) AS cost FROM c GROUP BY 1, 2),
n AS (SELECT *, sum(cost) OVER (PARTITION BY month) AS network_cost FROM m)
SELECT tenant_id, month, calls, cost::DOUBLE AS cost, network_cost::DOUBLE AS network_cost, calls < 10 AND cost < 0.01 AND network_cost < 1 AS within FROM n""")(
    lambda u: A.budget_status(A.token_cost(u, _rates(u), "m-small"), 10, 0.01, 1.0).withColumns({c: F.col(c).cast("double") for c in ("cost", "network_cost")})
)
query("n9_rolling_7d_questions", "questions", """
, d AS (SELECT created_at::DATE AS day, count(*) AS n FROM questions GROUP BY 1)
SELECT day, n, (sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))::BIGINT AS trailing FROM d""")(A.rolling_questions)
