"""Registered imports, integrity checks, pattern work and state folds, with independent SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbspark.functions import text as X
from kbspark.operators import conversations as C
from kbspark.operators import integrity as M
from kbspark.plans.fixtures import AS_OF, PROJECTIONS, projection, table, with_projections
from kbspark.sources import tables as S
from kbspark.streaming import events as W
from kbspark.streaming import limits as L
from kbspark.streaming import stored as D

QUERIES: dict = {}
ORACLES: dict = {}
T = "TIMESTAMP '2024-01-31 00:00:00'"


def query(name: str, tables: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda s, d: f(*(projection(s, d, t) if t in PROJECTIONS else table(s, d, t) for t in tables.split()))
        if sql:
            own = " ".join(t for t in tables.split() if t in PROJECTIONS)
            ORACLES[name] = with_projections(own, sql) if own else ("WITH " + sql.strip()[1:] if sql.strip().startswith(",") else sql.strip())

    return register


query("s4_export_questions_csv", "questions", "SELECT question, matched_keyword, match_type, ip_address, created_at FROM questions ORDER BY created_at DESC, id DESC LIMIT 10000")(S.newest_questions)
query("s5_export_leads_csv", "customer", "SELECT c_custkey AS id, c_name AS name FROM customer")(lambda c: S.newest_leads(c.selectExpr("c_custkey as id", "c_name as name", "c_custkey as created_at")).select("id", "name"))
query("s7_preview_import", "knowledge", """
, i AS (SELECT keyword, CASE WHEN id % 3 = 0 THEN 'new-' || id ELSE coalesce(sub_keyword, '') END AS s FROM knowledge WHERE id % 2 = 0), e AS (SELECT DISTINCT keyword, coalesce(sub_keyword, '') AS s FROM knowledge)
SELECT count(*) AS total, count(*) FILTER (e.s IS NULL) AS new, count(e.s) AS duplicate FROM i LEFT JOIN e ON e.keyword = i.keyword AND e.s = i.s""")(
    lambda k: S.preview_import(k.where("id % 2 = 0").selectExpr("keyword", "if(id % 3 = 0, concat('new-', id), sub_keyword) as sub_keyword"), k, ["keyword", "sub_keyword"])
)
query("s8_import_remap_sources", "pages", """
, i AS (SELECT page_id AS old_id, url FROM pages WHERE page_id % 2 = 0), e AS (SELECT url, min(page_id) AS known FROM pages WHERE page_id % 4 = 0 GROUP BY 1), j AS (SELECT old_id, known FROM i LEFT JOIN e ON e.url = i.url)
SELECT old_id, known AS new_id, false AS inserted FROM j WHERE known IS NOT NULL UNION ALL
SELECT old_id, (SELECT max(page_id) FROM pages WHERE page_id % 4 = 0) + row_number() OVER (ORDER BY old_id), true FROM j WHERE known IS NULL""")(
    lambda p: S.remap_sources(p.where("page_id % 2 = 0").selectExpr("page_id as id", "url"), p.where("page_id % 4 = 0").selectExpr("page_id as id", "url"))
)
query("s9_import_categories_remap", "categories", "SELECT id + 100 AS id, name, CASE WHEN parent_id IS NOT NULL THEN parent_id + 100 END AS parent_id FROM categories")(lambda c: S.remap_categories(c, c.selectExpr("id as old_id", "id + 100 as new_id")))
_LEGACY = "p_partkey as id, case when p_partkey % 9 = 0 then '' when p_partkey % 5 = 0 then concat(p_brand, '*') else p_brand end as keyword, p_type as subkeyword, case when p_partkey % 2 = 0 then p_name end as question, p_name as response, case p_partkey % 4 when 0 then 'A' when 1 then '0' when 2 then 'D' else 'x' end as status, case when p_partkey % 3 = 0 then '0000-00-00' else '2024-05-06' end as expdate, p_size as hits, p_partkey % 6 as rate"
query("s10_legacy_knowledge_import", "part", f"""
, l AS (SELECT {_LEGACY} FROM part)
SELECT id, keyword, CASE WHEN question IS NULL THEN keyword ELSE question END AS question, CASE status WHEN 'A' THEN 'active' WHEN '0' THEN 'inactive' WHEN 'D' THEN 'hold' ELSE 'active' END AS status, CASE WHEN keyword LIKE '%*' THEN 'pattern' ELSE 'contains' END AS search_type,
  CASE WHEN expdate LIKE '0000%' THEN NULL ELSE expdate::DATE END AS expires_at, CASE WHEN rate > 0 THEN floor(hits * rate / 5.0)::INTEGER ELSE 0 END AS helpful_yes, CASE WHEN rate > 0 THEN greatest(0, hits - floor(hits * rate / 5.0)::INTEGER) ELSE 0 END AS helpful_no FROM l WHERE keyword <> ''""")(
    lambda p: S.legacy_knowledge(p.selectExpr(*_split(_LEGACY))).select("id", "keyword", "question", "status", "search_type", "expires_at", "helpful_yes", "helpful_no")
)


def _split(columns: str) -> list[str]:
    """Comma-separated expressions, commas within brackets apart."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


query("s11_legacy_synonyms_group", "part", """
, r AS (SELECT p_partkey AS ord, lower(split_part(p_name, ' ', 1)) AS m, lower(split_part(p_name, ' ', 2)) AS c FROM part), f AS (SELECT c, m, min(ord) AS ord FROM r WHERE m <> c GROUP BY 1, 2)
SELECT c AS canonical_word, string_agg(m, ',' ORDER BY ord) AS misspellings, contains(c, ' ')::INTEGER AS is_phrase FROM f GROUP BY 1""")(lambda p: S.legacy_synonyms(p.selectExpr("p_partkey as ord", "split(p_name, ' ')[0] as misspelling", "upper(split(p_name, ' ')[1]) as canonical")))
query("s12_legacy_stopwords_upsert", "part nation", "SELECT DISTINCT lower(p_brand) AS word, 1 AS is_active FROM part UNION ALL SELECT n_name, 0 FROM nation")(
    lambda p, n: S.upsert_stopwords(n.selectExpr("n_name as word", "0 as is_active"), p.selectExpr("concat(' ', p_brand) as word"))
)
query("s13_legacy_questions_import", "questions", f"SELECT id, CASE WHEN matched_keyword IS NULL THEN 'none' ELSE 'partial' END AS match_type, CASE WHEN matched_keyword IS NULL THEN 0 ELSE 100 END AS match_score FROM questions WHERE created_at >= {T} - INTERVAL 10 DAY")(
    lambda q: S.legacy_questions(q.withColumnRenamed("matched_keyword", "keyword"), AS_OF, 10).select("id", "match_type", "match_score")
)
query("s14_legacy_html_clean", "pages", """
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace('<font color=''#f00''><center>' || html || '</center></font>', '(?i)<font[^>]*color=["'']?([#\\w]+)["'']?[^>]*>', '<span style="color:\\1">', 'g'), '</font>', '</span>'), '</FONT>', '</span>'),
  '(?i)<(/?)center>', '<\\1div>', 'g'), '(?s)<!--\\[if.*?<!\\[endif\\]-->', '', 'g'), '\\s+', ' ', 'g')) AS html FROM pages""")(lambda p: p.select("page_id", S.clean_legacy_html(F.concat(F.lit("<?xml v?><font color='#f00'><center>"), "html", F.lit("</center></font>"))).alias("html")))
query("s15_seed_pack_insert_if_absent", "knowledge", "SELECT min(id) AS id, keyword, sub_keyword FROM knowledge WHERE id % 3 > 0 AND keyword || '|' || coalesce(sub_keyword, '') NOT IN (SELECT keyword || '|' || coalesce(sub_keyword, '') FROM knowledge WHERE id % 3 = 0) GROUP BY 2, 3")(
    lambda k: S.insert_if_absent(k.where("id % 3 > 0").select("id", "keyword", "sub_keyword"), k.where("id % 3 = 0").select("keyword", "sub_keyword"), ["keyword", "sub_keyword"])
)
query("s16_bulk_questions_csv", "match_questions", "SELECT id AS row_index, question FROM match_questions WHERE id % 7 > 0")(lambda q: S.bulk_questions(q.selectExpr("id as row_index", "if(id % 7 = 0, ' ', question) as question")))
query("s17_retention_prune", "request_metrics", f"SELECT id FROM request_metrics WHERE created_at >= {T} - INTERVAL 7 DAY")(lambda m: S.retention_prune(m, AS_OF, 7).select("id"))
query("s18_cache_expiry", "usage", "SELECT tenant_id, count(*) AS n FROM usage WHERE created_at > TIMESTAMP '1997-01-01 00:00:00' AND tenant_id <> 7 GROUP BY 1")(lambda u: S.unexpired(u.withColumnRenamed("created_at", "expires_at"), "1997-01-01 00:00:00", 7).groupBy("tenant_id").agg(F.count("*").alias("n")))

_TOK = "[x FOR x IN list_distinct([replace(y, '*', '') FOR y IN string_split_regex(lower(coalesce(P, '')), '[|&+\\s]+')]) IF x <> '']"
query("m1_pattern_tokens", "knowledge", f"SELECT id, list_sort({_TOK.replace('P', 'sub_keyword')}) AS tokens FROM knowledge")(lambda k: k.select("id", F.sort_array(M.pattern_tokens(F.col("sub_keyword"))).alias("tokens")))
query("m2_reuse_repair", "knowledge", f"""
, k AS (SELECT id, keyword || '-' || id % 97 AS keyword, sub_keyword, {_TOK.replace('P', 'sub_keyword')} AS t FROM knowledge), o AS (SELECT id AS orphan_id, keyword, {_TOK.replace('P', "sub_keyword || '|extra'")} AS a FROM k),
p AS (SELECT orphan_id, k.id, round(len(list_intersect(a, t))::DOUBLE / (len(a) + len(t) - len(list_intersect(a, t))), 2) AS s FROM o JOIN k ON k.keyword = o.keyword),
r AS (SELECT *, row_number() OVER (PARTITION BY orphan_id ORDER BY s DESC, id) AS n, coalesce(lead(s) OVER (PARTITION BY orphan_id ORDER BY s DESC, id), 0) AS second FROM p)
SELECT orphan_id, id AS target_id, s AS similarity, s >= 0.6 AND round(s - second, 2) >= 0.2 AS auto FROM r WHERE n = 1""")(
    lambda k: (lambda own: M.reuse_repair(own.selectExpr("id", "keyword", "concat(sub_keyword, '|extra') as pattern"), own))(k.selectExpr("id", "concat(keyword, '-', id % 97) as keyword", "sub_keyword"))
)
query("m3_stranded_embeddings", "vector_chunks knowledge", "SELECT content_id FROM vector_chunks WHERE content_type = 'kb_entry' AND is_current AND content_id NOT IN (SELECT id FROM knowledge WHERE status = 'active')")(
    lambda v, k: M.guarded(M.stranded(v, k.where("status = 'active'").select(F.col("id").alias("content_id")), "kb_entry"), 1000, True).select("content_id")
)
query("m4_missing_embeddings", "vector_chunks knowledge", "SELECT id AS content_id FROM knowledge WHERE status = 'active' AND id NOT IN (SELECT content_id FROM vector_chunks WHERE content_type = 'kb_entry' AND is_current)")(
    lambda v, k: M.missing(k.where("status = 'active'").select(F.col("id").alias("content_id")), v, "kb_entry")
)
query("m5_embedding_status", "vector_chunks", "SELECT content_type, count(*) AS total, count(*) FILTER (is_current) AS current FROM vector_chunks GROUP BY 1")(M.embedding_status)
_QUEUED = "event_id, user_id as content_id, ts, case event_type when 'signup' then 'enqueue' when 'purchase' then 'success' when 'error' then 'retry' else 'failure' end as kind"
query("m5_embedding_report", "vector_chunks knowledge chunks events", f"""
, k AS (SELECT {_QUEUED} FROM events), r AS (SELECT content_id, max((ts, event_id)) AS m, arg_max(kind, (ts, event_id)) AS reset FROM k WHERE kind <> 'failure' GROUP BY 1),
f AS (SELECT k.content_id, any_value(reset) AS reset, count(*) FILTER (kind = 'failure' AND (m IS NULL OR (ts, event_id) > m)) AS fails FROM k LEFT JOIN r ON r.content_id = k.content_id GROUP BY 1),
s AS (SELECT CASE WHEN reset = 'success' AND fails = 0 THEN 'done' WHEN fails >= 3 THEN 'failed' ELSE 'pending' END AS status FROM f),
e AS (SELECT id FROM knowledge WHERE status = 'active'), v AS (SELECT DISTINCT content_type, content_id FROM vector_chunks WHERE is_current)
SELECT 'pending' AS name, count(*) FILTER (status = 'pending') AS n FROM s UNION ALL SELECT 'processing', 0 UNION ALL SELECT 'failed', count(*) FILTER (status = 'failed') FROM s
UNION ALL SELECT 'total_kb_entries', count(*) FROM e UNION ALL SELECT 'total_chunks', count(*) FROM chunks UNION ALL SELECT 'embedded_kb_entries', count(*) FROM v WHERE content_type = 'kb_entry' AND content_id IN (SELECT id FROM e)
UNION ALL SELECT 'embedded_chunks', count(*) FROM v WHERE content_type = 'chunk' AND content_id IN (SELECT id FROM chunks)
UNION ALL SELECT 'stranded_rows', count(*) FROM v WHERE (content_type = 'kb_entry' AND content_id NOT IN (SELECT id FROM e)) OR (content_type = 'chunk' AND content_id NOT IN (SELECT id FROM chunks))""")(
    lambda v, k, c, e: M.embedding_report(v, k.where("status = 'active'").selectExpr("id as content_id"), c.selectExpr("id as content_id"), M.queue_fold(e.selectExpr(*_split(_QUEUED))))
)
query("m6_vector_upsert", "vector_chunks", "SELECT content_type, content_id, CASE WHEN content_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM vector_chunks")(
    lambda v: M.vector_upsert(v.selectExpr("content_type", "content_id", "1 as version"), v.where("content_id % 3 = 0").selectExpr("content_type", "content_id", "2 as version"), ["content_type", "content_id"])
)
query("m7_mark_stale", "vector_chunks", "SELECT content_id, is_current AND source_id NOT IN (1, 2) AS is_current FROM vector_chunks")(lambda v: M.mark_stale(v, v.where("source_id in (1, 2)").select("source_id")).select("content_id", "is_current"))
#: Entries of which some have a pointer and some no question; legacy rows of two thirds of them; which have phrasings already.
_HELD = "id, keyword, sub_keyword, case when id % 17 = 0 then ' ' else question end as question, case when id % 7 = 0 then 1 else 0 end as reuse_response"
_OLD = "id, keyword, sub_keyword as subkeyword, case id % 4 when 0 then '' when 1 then ' one phrase | one phrase ' when 2 then 'first one|ab|second one' else 'x' end as rq, case id % 3 when 1 then 'yes' else 'no' end as reuse, case when id % 5 = 0 then '' else 'rod' end as rkey, case when id % 2 = 0 then '' else 'red' end as rsubkey"
_BUCKETS = f"""
, h AS (SELECT {_HELD} FROM knowledge), l AS (SELECT {_OLD} FROM knowledge WHERE id % 3 > 0), o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY keyword, subkeyword ORDER BY id DESC) = 1),
j AS (SELECT h.id, trim(question) AS q, lower(trim(coalesce(sub_keyword, ''))) IN ('', 'aadefault') AS plain, reuse_response, o.id IS NOT NULL AS matched, coalesce(o.rq, '') <> '' AS listed, reuse, rkey, CASE rsubkey WHEN '' THEN 'aadefault' ELSE rsubkey END AS rsub, h.id % 11 = 0 AS has,
  coalesce(list_distinct([trim(x) FOR x IN string_split(o.rq, '|') IF length(trim(x)) >= 3]), []) AS p FROM h LEFT JOIN o ON o.keyword = h.keyword AND o.subkeyword = h.sub_keyword),
b AS (SELECT *, CASE WHEN plain THEN [] WHEN len(p) > 0 THEN p WHEN length(q) >= 3 THEN [q] ELSE [] END AS v, CASE WHEN plain OR reuse IS DISTINCT FROM 'yes' OR rkey = '' THEN NULL WHEN reuse_response = 1 THEN 'set' ELSE 'missing' END AS pointer,
  CASE WHEN plain THEN 'aadefault' WHEN has THEN 'already_migrated' WHEN len(p) > 1 THEN 'matched_multi' WHEN len(p) = 1 THEN 'matched_single' WHEN length(q) < 3 THEN 'no_question' WHEN matched THEN 'matched_no_var' ELSE 'unmatched' END AS bucket FROM j)"""


def _moved(k):
    return k.selectExpr(*_split(_HELD)), k.where("id % 3 > 0").selectExpr(*_split(_OLD))


def _buckets(k):
    return M.migration_buckets(*_moved(k), k.where("id % 11 = 0").selectExpr("id as knowledge_id"))


query("m8_migration_buckets", "knowledge", _BUCKETS + " SELECT bucket, count(*) AS n, sum(CASE WHEN bucket <> 'already_migrated' THEN len(v) ELSE 0 END)::BIGINT AS variations, count(*) FILTER (pointer = 'set') AS pointers_set, count(*) FILTER (pointer = 'missing') AS pointers_missing FROM b GROUP BY 1")(
    lambda k: _buckets(k).groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.when(F.col("bucket") != "already_migrated", F.size("variations")).otherwise(0)).alias("variations"), F.count_if(F.col("pointer") == "set").alias("pointers_set"), F.count_if(F.col("pointer") == "missing").alias("pointers_missing"))
)
query("m10_apply_migration", "knowledge", _BUCKETS + " SELECT id AS knowledge_id, unnest(v) AS variation_text FROM b WHERE NOT plain AND NOT has")(lambda k: M.apply_migration(_buckets(k)).select("knowledge_id", "variation_text"))
query("m10_missing_pointers", "knowledge", _BUCKETS + " SELECT id, 1 AS reuse_response, rkey AS reuse_keyword, rsub AS reuse_sub_keyword FROM b WHERE pointer = 'missing'")(lambda k: M.missing_pointers(_buckets(k)))
query("m10_migration_stats", "knowledge", _BUCKETS + """, d AS (SELECT *, NOT plain AND NOT has AND len(v) > 0 AS adds, coalesce(pointer = 'missing', false) AS sets FROM b)
SELECT count(*) AS total_rows, count(*) FILTER (plain) AS aadefault_skipped, count(*) FILTER (NOT plain AND NOT adds AND NOT sets) AS already_migrated, count(*) FILTER (NOT plain AND NOT has AND listed AND len(v) > 0) AS matched_with_variations,
  count(*) FILTER (NOT plain AND NOT has AND matched AND NOT (listed AND len(v) > 0)) AS matched_no_variations, count(*) FILTER (NOT plain AND NOT has AND NOT matched) AS unmatched_fallback, count(*) FILTER (sets) AS reuse_pointers_restored, coalesce(sum(len(v)) FILTER (adds), 0)::BIGINT AS variations_inserted FROM d""")(
    lambda k: M.migration_stats(_buckets(k))
)
query("m9_replace_variations", "knowledge", """
, v AS (SELECT id % 100 AS knowledge_id, trim(question) AS t, id AS o FROM knowledge WHERE id % 7 > 0) SELECT knowledge_id, t AS variation_text, (row_number() OVER (PARTITION BY knowledge_id ORDER BY o, t) - 1)::INTEGER AS sort_order FROM v""")(
    lambda k: M.replace_variations(k.selectExpr("id % 100 as knowledge_id", "if(id % 7 = 0, '  ', concat(' ', question)) as variation_text", "id as sort_order"))
)
query("m11_restore_reuse_pointers", "knowledge", _BUCKETS + """, r AS (SELECT id, rkey, rsub, CASE WHEN reuse_response = 1 THEN 'already_set' WHEN NOT matched THEN 'no_match' WHEN reuse = 'yes' AND rkey <> '' THEN 'restored' ELSE 'says_no' END AS outcome FROM b WHERE NOT plain)
SELECT id, outcome, CASE WHEN outcome = 'restored' THEN rkey END AS reuse_keyword, CASE WHEN outcome = 'restored' THEN rsub END AS reuse_sub_keyword FROM r""")(lambda k: M.restore_reuse_pointers(*_moved(k)))
query("m12_synonym_conflicts", "part match_kb", """
, s AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS c, unnest([lower(split_part(p_name, ' ', 2)), 'zzz']) AS v FROM part) SELECT c AS canonical_word, v AS variant FROM s WHERE v <> c AND v IN (SELECT lower(keyword) FROM match_kb)""")(
    lambda p, k: M.synonym_conflicts(p.selectExpr("split(p_name, ' ')[0] as canonical_word", "concat(split(p_name, ' ')[1], ', zzz') as variant_words", "cast(null as string) as misspellings"), k)
)
_VARS = "SELECT id % 50 AS knowledge_id, question AS variation_text, id AS sort_order FROM knowledge"
query("p10_clean_pattern", "knowledge", "SELECT id, CASE WHEN sub_keyword = 'aadefault' THEN 'aadefault|more' ELSE replace(sub_keyword, '&rod', '') || '|more' END AS pattern FROM knowledge")(
    lambda k: k.select("id", M.clean_pattern(F.concat("sub_keyword", F.lit("|ab|*|how|more")), F.lit("rod"), ["how"]).alias("pattern"))
)
query("p11_primary_keyword", "knowledge", f"""
, v AS ({_VARS}), w AS (SELECT knowledge_id, sort_order, unnest(string_split_regex(lower(variation_text), '\\W+')) AS word, generate_subscripts(string_split_regex(lower(variation_text), '\\W+'), 1) AS pos FROM v),
c AS (SELECT knowledge_id, word, count(DISTINCT sort_order) AS n, min(row(sort_order, pos)) AS first FROM w WHERE length(word) >= 3 AND word <> 'about' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY knowledge_id ORDER BY n DESC, first, word) AS k FROM c)
SELECT knowledge_id, word, n FROM r WHERE k = 1""")(lambda k: M.primary_keyword(k.selectExpr("id % 50 as knowledge_id", "question as variation_text", "id as sort_order"), X.STOPWORDS))
query("e3_bulk_run_summary", "request_metrics", """
, r AS (SELECT question_id % 20 AS run_id, CASE WHEN gate_fired IS NULL AND question_id % 20 > 3 THEN 'open' WHEN gate_fired = 1 THEN 'failed' ELSE 'done' END AS status, cost FROM request_metrics)
SELECT run_id, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, sum(cost)::DOUBLE AS cost, count(*) FILTER (status = 'open') AS remaining, CASE WHEN count(*) FILTER (status = 'open') = 0 THEN 'complete' ELSE 'running' END AS state FROM r GROUP BY 1""")(
    lambda m: M.bulk_run_summary(m.selectExpr("question_id % 20 as run_id", "case when gate_fired is null and question_id % 20 > 3 then 'open' when gate_fired = 1 then 'failed' else 'done' end as status", "cost")).withColumn("cost", F.col("cost").cast("double"))
)
query("c6_promote_or_reject", "ai_answers", """
, d AS (SELECT DISTINCT lower(trim(question)) AS q FROM ai_answers WHERE conversation_id % 6 = 0) SELECT id, CASE WHEN status = 'pending' AND q IS NOT NULL THEN 'promoted' ELSE status END AS status FROM ai_answers a LEFT JOIN d ON d.q = lower(trim(a.question))""")(
    lambda a: M.promote(a, a.where("conversation_id % 6 = 0").selectExpr("question", "'promoted' as status")).select("id", "status")
)
query("c8_repeat_question", "conversations", """
SELECT DISTINCT b.conv_id, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.role = 'user' AND b.role = 'user' AND trim(regexp_replace(regexp_replace(lower(a.text), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) = trim(regexp_replace(regexp_replace(lower(b.text), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))""")(
    lambda c: (lambda u: u.join(u.groupBy("conv_id", "k").agg(F.min("turn").alias("first")), ["conv_id", "k"]).where("turn > first").select("conv_id", "turn"))(c.where("role = 'user'").select("conv_id", "turn", X.dedup_key(F.col("text")).alias("k")))
)



def _asked_again(c):
    """The conversations, in every third of which the user asks everything once more, in a few words more."""
    more = c.where("role = 'user' and conv_id % 3 = 0").select("conv_id", (F.col("turn") + 100).alias("turn"), "role", F.concat("text", F.lit(" - please, please!")).alias("text"))
    return C.repeated_questions(c.select("conv_id", "turn", "role", "text").union(more)).withColumn("similarity", F.round("similarity", 9))


query("c8_repeat_near", "conversations", """
WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn + 100, text || ' - please, please!' FROM conversations WHERE role = 'user' AND conv_id % 3 = 0),
k AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM c), w AS (SELECT conv_id, turn, string_split(k, ' ') AS w FROM k WHERE k <> ''),
p AS (SELECT b.conv_id, b.turn, a.turn AS first_turn, len([x FOR x IN a.w IF list_contains(b.w, x)])::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS similarity FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn < b.turn),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY similarity DESC, first_turn) AS n FROM p WHERE similarity >= 0.85)
SELECT conv_id, turn, first_turn, round(similarity, 9) AS similarity FROM r WHERE n = 1""".replace("\\\\", "\\"))(_asked_again)
_COUNTS = "count(*) AS total, count(*) FILTER (match_type <> 'none') AS matched, count(*) FILTER (match_type IS NULL OR match_type = 'none') AS unmatched"
query("w1_question_counts_tumbling", "questions", f"SELECT date_trunc('hour', created_at) AS start_at, date_trunc('hour', created_at) + INTERVAL 1 HOUR AS end_at, {_COUNTS} FROM questions GROUP BY 1, 2")(W.question_counts)
query("w2_match_rate_sliding", "questions", f"""
, w AS (SELECT date_trunc('day', created_at) - to_days(d::INTEGER) AS start_at, match_type FROM questions, range(7) t(d))
SELECT start_at, start_at + INTERVAL 7 DAY AS end_at, {_COUNTS}, round(100.0::DOUBLE * count(*) FILTER (match_type <> 'none') / count(*), 1) AS match_rate FROM w GROUP BY 1""")(W.match_rate_sliding)
query("w3_conversation_sessions", "questions", """
, g AS (SELECT ip_address, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY ip_address ORDER BY created_at) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM questions), s AS (SELECT *, sum(n) OVER (PARTITION BY ip_address ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT ip_address, min(created_at) AS start_at, count(*) AS turns FROM s GROUP BY ip_address, k""")(W.visitor_sessions)
def _accepted(of: str, most: int) -> str:
    """The fold in SQL: event by event, the count and the time of the last one that counted."""
    return f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE {of}),
f AS (SELECT event_id, user_id, ts, k, 1 AS n, ts AS last, true AS accepted FROM e WHERE k = 1 UNION ALL
  SELECT event_id, user_id, ts, k, CASE WHEN before < {most} THEN before + 1 ELSE before END, CASE WHEN before < {most} THEN ts ELSE last END, before < {most} FROM (
  SELECT e.*, f.last, CASE WHEN epoch(e.ts) - epoch(f.last) >= 86400 THEN 0 ELSE f.n END AS before FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
SELECT event_id, user_id, ts, accepted FROM f"""


query("w4_rate_limit", "events", _accepted("true", 3))(lambda e: M.accepted(e.selectExpr("event_id", "user_id", "ts"), ["user_id"], 86400, 3))
query("w4_rate_limit_stream", "events", _accepted("true", 3))(lambda e: _limited(e.selectExpr("event_id", "user_id", "ts"), lambda x: L.accepted_stream(x, ["user_id"], 86400, 3)))
query("w5_rating_dedupe_stream", "events", _accepted("event_type = 'click'", 1))(lambda e: _limited(e.where("event_type = 'click'").selectExpr("event_id", "user_id", "ts"), lambda x: L.accepted_stream(x, ["user_id"], 86400, 1)))
query("w5_rating_dedupe", "events", _accepted("event_type = 'click'", 1))(lambda e: M.accepted(e.where("event_type = 'click'").selectExpr("event_id", "user_id", "ts"), ["user_id"], 86400, 1))


def _inquiries(e):
    """Events as inquiries of their user; five in ten days are as near to a limit here as five in an hour are in use."""
    return e.select("event_id", F.col("user_id").alias("ip"), "ts", X.is_spam(F.when(F.col("event_id") % 9 == 0, "win the lottery").otherwise(F.col("event_type"))).alias("spam"))


_THROTTLED = """
WITH RECURSIVE e AS (SELECT event_id, user_id AS ip, ts, event_id % 9 = 0 AS spam FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts, event_id, spam) AS k FROM e WHERE NOT spam),
f AS (SELECT event_id, ip, ts, k, [ts] AS l, 'stored' AS outcome FROM o WHERE k = 1 UNION ALL
  SELECT event_id, ip, ts, k, CASE WHEN full_ THEN l ELSE list_append(CASE WHEN len(l) = 5 THEN l[2:] ELSE l END, ts) END, CASE WHEN full_ THEN 'throttled' ELSE 'stored' END FROM (
  SELECT o.*, f.l, len(f.l) = 5 AND epoch(o.ts) - epoch(f.l[1]) < 864000 AS full_ FROM f JOIN o ON o.ip = f.ip AND o.k = f.k + 1))
SELECT event_id, outcome FROM f UNION ALL SELECT event_id, 'spam' FROM e WHERE spam"""
query("w6_inquiry_throttle", "events", _THROTTLED)(
    lambda e: M.throttled(_inquiries(e), ["ip"], 864000).select("event_id", "outcome")
)
query("w6_inquiry_throttle_stream", "events", _THROTTLED)(lambda e: _limited(_inquiries(e), lambda x: L.throttled_stream(x, ["ip"], 864000)).select("event_id", "outcome"))


def _limited(rows, stream):
    """What a limit makes of the rows as a stream that is stopped in the middle and started again."""
    folder, spark = S.scratch(rows.sparkSession), rows.sparkSession
    rows = S.written(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    ends = rows.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    middle = F.lit(ends["first"] + (ends["last"] - ends["first"]) / 2)
    for part in (F.col("ts") <= middle, F.col("ts") > middle):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        made = stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        W.run_available(made, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(made.schema).parquet(f"{folder}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


query("w7_visitors_upsert", "questions", "SELECT ip_address, count(*) AS visit_count, min(created_at) AS first_visit, max(created_at) AS last_visit FROM questions GROUP BY 1")(
    lambda q: W.visitors_upsert(q.where("id % 2 = 0"), q.where("id % 2 = 1").groupBy("ip_address").agg(F.count("*").alias("visit_count"), F.min("created_at").alias("first_visit"), F.max("created_at").alias("last_visit")))
)


def _visitors(q):
    rows, folder = S.written(q.select("ip_address", F.col("created_at").cast("timestamp").alias("created_at"), "id")), S.scratch(q.sparkSession)
    for part in range(2):
        rows.where(F.col("id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        stream = q.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in")
        stored = D.visitors_stream(stream, f"{folder}/visitors", f"{folder}/checkpoint")
    return stored.read().withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_visit", "last_visit")})


query("w7_visitors_upsert_stream", "questions", "SELECT ip_address, count(*) AS visit_count, min(created_at) AS first_visit, max(created_at) AS last_visit FROM questions GROUP BY 1")(_visitors)
query("w8_embedding_queue_fold", "events", f"""
, k AS (SELECT {_QUEUED} FROM events), r AS (SELECT content_id, max((ts, event_id)) AS m, arg_max(kind, (ts, event_id)) AS reset FROM k WHERE kind <> 'failure' GROUP BY 1),
f AS (SELECT k.content_id, any_value(reset) AS reset, count(*) FILTER (kind = 'failure' AND (m IS NULL OR (ts, event_id) > m)) AS fails FROM k LEFT JOIN r ON r.content_id = k.content_id GROUP BY 1)
SELECT content_id, CASE WHEN reset = 'success' AND fails = 0 THEN 'done' WHEN fails >= 3 THEN 'failed' ELSE 'pending' END AS status, least(fails, 3)::INTEGER AS retry_count FROM f""")(lambda e: M.queue_fold(e.selectExpr(*_split(_QUEUED))))
query("w8_queue_claim", "events", f"""
, k AS (SELECT {_QUEUED} FROM events), r AS (SELECT content_id, max((ts, event_id)) AS m, arg_max(kind, (ts, event_id)) AS reset FROM k WHERE kind <> 'failure' GROUP BY 1),
f AS (SELECT k.content_id, any_value(reset) AS reset, max(ts) AS updated_at, count(*) FILTER (kind = 'failure' AND (m IS NULL OR (ts, event_id) > m)) AS fails FROM k LEFT JOIN r ON r.content_id = k.content_id GROUP BY 1)
SELECT 'chunk' AS content_type, content_id, 'pending' AS status, fails::INTEGER AS retry_count, updated_at FROM f WHERE fails < 3 AND NOT (reset IS NOT DISTINCT FROM 'success' AND fails = 0) ORDER BY updated_at, content_id LIMIT 20""")(
    lambda e: D.claimed(D.queue_rows(e.sparkSession.createDataFrame([], D.QUEUE), e.selectExpr("'chunk' as content_type", *_split(_QUEUED)))).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
)
query("w9_request_metrics_build", "request_metrics", "SELECT id AS request_id, question_id, total_ms, kb_ms, retrieval_ms, synthesis_ms, greatest(0, total_ms - kb_ms - coalesce(retrieval_ms, 0) - coalesce(synthesis_ms, 0)) AS render_ms FROM request_metrics")(
    lambda m: M.request_metrics(m.select(F.col("id").alias("request_id"), "question_id", F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"{s}_ms").alias("ms")) for s in ("total", "kb", "retrieval", "synthesis")))).alias("x")).select("request_id", "question_id", "x.stage", "x.ms"))
)
query("w10_late_rejections", "questions", "SELECT id, created_at, CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS ai_rejected FROM questions")(
    lambda q: W.late_rejections(q, q.where("id % 13 = 0").select(F.col("id").alias("question_id"), (F.col("created_at") + F.expr("interval 5 minutes")).alias("rejected_at")))
)
