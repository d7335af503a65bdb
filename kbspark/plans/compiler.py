"""Registered pattern work, follow-ups, evaluation and round trips of files, with independent SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import text as X
from kbspark.operators import conversations as C
from kbspark.operators import evaluation as E
from kbspark.operators import language as L
from kbspark.operators import matching as K
from kbspark.operators import patterns as P
from kbspark.plans import text as PT
from kbspark.plans.fixtures import projection, table, with_projections
from kbspark.plans.language import STEMS
from kbspark.sources import tables as S

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, f, sql: str | None = None, tables: str = ""):
    QUERIES[name] = f
    if sql:
        ORACLES[name] = with_projections(tables, sql) if tables else sql.strip()


#: Phrasings of forty entries, whose keyword the parts' second words are, and what their words are used as.
_VARIATIONS = """SELECT split_part(p_name, ' ', 2) AS keyword, CAST(p_partkey % 8 AS bigint) * 100 + length(p_name) AS entry_id, p_partkey AS no,
  CASE p_partkey % 3 WHEN 0 THEN concat('How can I not find the ', p_name, ' catalog online') WHEN 1 THEN concat('another ', p_name, ' from your catalog at work') ELSE concat('catalog of ', p_name, 's, ', p_brand, ' kind') END AS text FROM part"""
_POS = "SELECT DISTINCT split_part(p_name, ' ', 1) AS word, 'a' AS pos FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2), 'n' FROM part UNION SELECT DISTINCT 'catalog', 'n' FROM part UNION SELECT DISTINCT 'work', 'nv' FROM part"


def _sql(s, d, sql):
    table(s, d, "part").createOrReplaceTempView("part")
    return s.sql(sql)


def _variations(s, d):
    return _sql(s, d, _VARIATIONS)


def _words(s, d):
    """A dictionary of the parts' words."""
    return table(s, d, "part").select(F.col("p_partkey").alias("ord"), F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.min("ord").alias("ord"))


def _tokens(s, d):
    own = _variations(s, d)
    plain = own.select("text").distinct().select(F.explode(X.word_synonyms(X.tokenize(X.normalize_question(F.col("text"))))).alias("token")).union(own.select(F.col("keyword")))
    return P.compiled_tokens(own, L.stem_tokens(plain, _words(s, d)))


def _scored(s, d, tokens=None):
    return P.with_points(_tokens(s, d) if tokens is None else tokens, _sql(s, d, _POS), _words(s, d))


def _picked(s, d):
    tokens = _tokens(s, d)
    return P.discriminators(S.written(_scored(s, d, tokens)), P.shared_anchors(tokens))


def _patterns(s, d):
    return P.compile_patterns(_tokens(s, d), _sql(s, d, _POS), _words(s, d))


_T = f"""WITH v AS ({_VARIATIONS}), po AS (SELECT word, max(pos) AS pos FROM ({_POS}) GROUP BY 1), dict AS (SELECT word, min(ord) AS ord FROM (SELECT p_partkey AS ord, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1),
vt AS (SELECT keyword, entry_id, no, text AS q FROM v), vw AS (SELECT keyword, entry_id, no, [coalesce({PT.SYNONYM}[t], t) FOR t IN {PT.WORDS}] AS w FROM vt),
vu AS (SELECT keyword, entry_id, no, unnest(w) AS token, generate_subscripts(w, 1) AS idx FROM vw), f AS (SELECT token FROM vu UNION SELECT keyword FROM v), {STEMS},
tk AS (SELECT vu.keyword, entry_id, no, idx, stem FROM vu JOIN st ON st.token = vu.token JOIN (SELECT token, stem AS kstem FROM st) k ON k.token = vu.keyword
  WHERE stem NOT IN (vu.keyword, kstem, vu.keyword || 's', vu.keyword || 'es') AND NOT (vu.keyword LIKE '%s' AND stem = vu.keyword[:-2])),
sf AS (SELECT keyword, entry_id, stem, (sum(own) OVER (PARTITION BY keyword, stem) - own)::BIGINT AS siblings FROM (SELECT keyword, entry_id, stem, count(DISTINCT no) AS own FROM tk WHERE length(stem) >= 2 GROUP BY 1, 2, 3)),
an AS (SELECT tk.keyword, tk.entry_id, stem, arg_min(idx, (no, idx)) AS place FROM tk JOIN (SELECT keyword, entry_id, count(DISTINCT no) AS total FROM tk GROUP BY 1, 2) n ON n.keyword = tk.keyword AND n.entry_id = tk.entry_id WHERE total >= 2 AND length(stem) >= 2 GROUP BY 1, 2, 3, total HAVING count(DISTINCT no) = total),
a AS (SELECT an.keyword, an.entry_id, an.stem, place FROM an JOIN sf ON sf.keyword = an.keyword AND sf.entry_id = an.entry_id AND sf.stem = an.stem WHERE siblings <= 4 AND an.stem NOT IN ('how', 'find', 'work', 'any', 'want')),
tp AS (SELECT tk.*, CASE WHEN stem IN ('online') THEN 'a' ELSE coalesce(pos, '') END AS pos FROM tk LEFT JOIN po ON po.word = tk.stem), tn AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY keyword, entry_id, no ORDER BY idx), '') AS next FROM tp),
td AS (SELECT *, row_number() OVER (PARTITION BY keyword, entry_id, no, stem ORDER BY idx) AS k FROM tn WHERE length(stem) >= 2),
sc AS (SELECT td.keyword, td.entry_id, no, idx, td.stem, siblings, (CASE WHEN regexp_matches(pos, '[nv]') THEN 3 WHEN pos = 'a' THEN 2 ELSE 0 END + CASE WHEN pos = 'a' AND contains(next, 'n') THEN 1.5 ELSE 0 END
  - CASE WHEN td.stem IN ('find', 'work') THEN 2 ELSE 0 END - CASE WHEN td.stem IN ('kind') THEN 2 ELSE 0 END - CASE WHEN td.stem = 'how' THEN 5 ELSE 0 END + CASE WHEN td.stem IN ('not', 'cannot', 'another') THEN 3 ELSE 0 END
  + CASE WHEN regexp_full_match(td.stem, '[a-z]{{3,6}}') AND pos = '' AND td.stem NOT IN (SELECT word FROM dict) AND td.stem NOT IN ('find', 'work', 'how', 'not', 'cannot', 'another') THEN 4 ELSE 0 END + greatest(0, 5 - siblings))::DOUBLE AS points
  FROM td JOIN sf ON sf.keyword = td.keyword AND sf.entry_id = td.entry_id AND sf.stem = td.stem WHERE k = 1)"""
register("p1_compile_tokens", lambda s, d: _tokens(s, d).withColumn("idx", F.col("idx") + 1), _T + " SELECT keyword, entry_id, no, idx, stem FROM tk")
register("p2_sibling_stem_freq", lambda s, d: P.sibling_frequency(_tokens(s, d)), _T + " SELECT * FROM sf")
register("p3_score_stem", lambda s, d: _scored(s, d).withColumn("idx", F.col("idx") + 1), _T + " SELECT * FROM sc")
register("p4_shared_anchor_stems", lambda s, d: P.shared_anchors(_tokens(s, d)).withColumn("place", F.col("place") + 1), _T + " SELECT * FROM a")
register("p5_pick_discriminator", _picked, _T + """,
cd AS (SELECT *, row_number() OVER (PARTITION BY keyword, entry_id, no ORDER BY points DESC, siblings, length(stem) DESC, idx) AS k FROM sc ANTI JOIN a USING (keyword, entry_id, stem)),
bs AS (SELECT keyword, entry_id, no, max(stem) FILTER (k = 1) AS s1, max(siblings) FILTER (k = 1) AS f1, max(stem) FILTER (k = 2) AS s2, max(points) FILTER (k = 2) AS p2 FROM cd GROUP BY 1, 2, 3),
h AS (SELECT keyword, entry_id, list(stem || '*' ORDER BY place, stem) AS l FROM a GROUP BY 1, 2)
SELECT x.keyword, x.entry_id, x.no, array_to_string(list_concat(list_filter([s1 || '*', CASE WHEN p2 >= 4 OR f1 > 0 THEN s2 || '*' END], lambda z: z IS NOT NULL), coalesce(l, [])), '&') AS pattern
FROM (SELECT DISTINCT keyword, entry_id, no FROM sc) x LEFT JOIN bs ON bs.keyword = x.keyword AND bs.entry_id = x.entry_id AND bs.no = x.no LEFT JOIN h ON h.keyword = x.keyword AND h.entry_id = x.entry_id WHERE s1 IS NOT NULL OR l IS NOT NULL""")
register("p6_compile_pattern", _patterns)
register("p7_tier_patterns", lambda s, d: P.tier_patterns(_variations(s, d), _tokens(s, d), _sql(s, d, _POS), _words(s, d)))
register("p8_detect_phrases", lambda s, d: P.detect_phrases(_tokens(s, d)).withColumn("phrases", F.array_join("phrases", "|")))


def _dryrun(s, d):
    patterns = projection(s, d, "knowledge").selectExpr("id as entry_id", "case id % 5 when 0 then '' when 1 then sub_keyword else concat(sub_keyword, '|more') end as pattern").where("entry_id % 7 > 0")
    return P.recompile_dryrun(projection(s, d, "knowledge"), patterns)


register("p9_recompile_dryrun", _dryrun, """, k AS (SELECT id, sub_keyword AS o, CASE WHEN id % 7 > 0 THEN CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN sub_keyword ELSE sub_keyword || '|more' END END AS p FROM knowledge WHERE status = 'active')
SELECT id, o AS old_pattern, CASE WHEN o = 'aadefault' THEN o ELSE coalesce(p, '') END AS new_pattern, CASE WHEN o = 'aadefault' THEN 'unchanged' WHEN coalesce(p, '') = '' THEN 'empty' WHEN p <> o THEN 'changed' ELSE 'unchanged' END AS status,
  o <> 'aadefault' AND coalesce(p, '') <> '' AND p <> o AS would_change, CASE WHEN o = 'aadefault' THEN 'aadefault: the pattern is fixed' WHEN p IS NULL THEN 'no variations to compile against' ELSE '' END AS reason FROM k""", "knowledge")
register("k12_suggest_keyword", lambda s, d: P.suggest_keyword(_tokens(s, d).withColumn("entry_id", F.col("no")), _sql(s, d, _POS), _words(s, d), projection(s, d, "match_kb")), _T + f""",
kb AS (SELECT keyword AS stem, count(*) AS n FROM (SELECT DISTINCT p_name, split_part(p_name, ' ', 2) AS keyword FROM part) GROUP BY 1), kp AS (SELECT sc.no AS entry_id, sc.stem, idx, points - greatest(0, 5 - siblings) + 5 + CASE WHEN n BETWEEN 2 AND 15 THEN 4 WHEN n = 1 THEN 2 WHEN n > 15 THEN 1 ELSE 0 END AS points FROM sc LEFT JOIN kb ON kb.stem = sc.stem WHERE length(sc.stem) >= 3)
SELECT * EXCLUDE (idx) FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY points DESC, idx)::INTEGER AS place FROM kp) WHERE place <= 3""")

#: The conversations, in which assistants offer something in turn and users take it up in several ways.
_TURNS = """SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN CASE conv_id % 4 WHEN 0 THEN concat(text, chr(10), 'Want to know more about Parking Fees?') WHEN 1 THEN concat(text, chr(10), chr(10), 'Did you mean the north gate?') WHEN 2 THEN concat(text, chr(10), 'Would you like to know how to apply? ') ELSE text END
  ELSE CASE (conv_id + turn) % 6 WHEN 0 THEN 'Yes!' WHEN 1 THEN 'sure, what are the parking fees?' WHEN 2 THEN ' Sounds  good ' WHEN 3 THEN concat('ok, ', text) WHEN 4 THEN 'yes, where is it?' ELSE text END END AS text FROM conversations"""


def _turns(s, d):
    table(s, d, "conversations").createOrReplaceTempView("conversations")
    return s.sql(_TURNS)


register("c7_resolve_followup", lambda s, d: C.resolve_followups(_turns(s, d)), f"""
WITH t AS ({_TURNS}), u AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM t),
o AS (SELECT conv_id, turn, text, CASE WHEN said IS NOT NULL THEN CASE conv_id % 4 WHEN 0 THEN 'parking Fees' WHEN 1 THEN 'did you mean the north gate' WHEN 2 THEN 'how to apply' END END AS topic, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS p FROM u WHERE role = 'user'),
m AS (SELECT *, p IN ('yes!', 'sounds good') AS pure, CASE WHEN regexp_matches(p, '^(yes|yeah|yep|sure|ok|okay)[,\\s]+[^\\s]') AND p NOT IN ('yes!', 'sounds good') THEN trim(regexp_extract(p, '^(?:yes|yeah|yep|sure|ok|okay)[,\\s]+(.+?)[\\s!.?]*$', 1)) END AS r FROM o),
k AS (SELECT *, CASE WHEN r <> '' AND (r LIKE '%?' OR regexp_matches(r, '(^|[^\\p{{L}}\\p{{N}}_])(what|when|where|why|how|who|which|can|could|do|does|is|are|will|would|should|may)([^\\p{{L}}\\p{{N}}_]|$)')) THEN r END AS rest FROM m)
SELECT conv_id, turn, CASE WHEN NOT pure AND rest IS NULL THEN 'not_affirmation' WHEN rest IS NOT NULL AND topic IS NOT NULL THEN 'followup_with_question' WHEN topic IS NULL THEN 'affirmation_no_pending_state' WHEN topic LIKE 'did you mean%' THEN 'answer_confirmation' ELSE 'followup_acceptance' END AS decision,
  CASE WHEN rest IS NOT NULL AND topic IS NOT NULL THEN CASE WHEN contains(lower(rest), lower(topic)) THEN trim(regexp_replace(rest, '[?!. ]+$', '')) ELSE topic || ' ' || trim(regexp_replace(rest, '[?!. ]+$', '')) END WHEN rest IS NOT NULL THEN rest WHEN pure AND topic IS NOT NULL THEN topic ELSE text END AS resolved_query FROM k""")

_WORDS_AND_BASE = "match_kb match_questions"


def _route(s, d):
    """The log's questions by their matches; every third has chunks, and for half of these an answer was made."""
    asked = projection(s, d, "match_questions").select("id", "question")
    return E.bulk_route(asked, K.find_matches(asked, projection(s, d, "match_kb"), dictionary=PT.dictionary(s, d)), asked.where("id % 3 = 0"), asked.where("id % 2 = 0").selectExpr("id", "id % 4 = 0 as answered"))


register("e4_bulk_route", _route, PT.MATCHED + """
SELECT q.id, CASE WHEN s.score >= 90 THEN 'kb_strong' WHEN q.id % 12 = 0 THEN CASE WHEN s.score IS NOT NULL THEN 'kb_weak_with_ai' ELSE 'ai_only' END ELSE 'no_answer' END AS layer
FROM match_questions q LEFT JOIN (SELECT question, max(score) AS score FROM every GROUP BY 1) s ON s.question = q.question""", _WORDS_AND_BASE)
register("e5_compare_runs", lambda s, d: E.compare_runs(projection(s, d, "ai_answers").selectExpr("conversation_id % 50 as question", "status as run_id", "answer", "id as created_at"), "promoted", "rejected"), """
, a AS (SELECT conversation_id % 50 AS question, status, arg_max(answer, id) AS answer FROM ai_answers WHERE status IN ('promoted', 'rejected') GROUP BY 1, 2)
SELECT question, max(answer) FILTER (status = 'promoted') AS first, max(answer) FILTER (status = 'rejected') AS second, coalesce(max(answer) FILTER (status = 'promoted') = max(answer) FILTER (status = 'rejected'), false) AS same FROM a GROUP BY 1""", "ai_answers")


def _roundtrip(s, d):
    asked = projection(s, d, "match_questions")
    part = table(s, d, "part").select(F.col("p_partkey").alias("true_part"), F.concat(F.lit("about the "), F.col("p_name")).alias("kq"))
    kb = projection(s, d, "match_kb").select(F.col("id").alias("entry_id"), F.col("question").alias("kq"))
    # the parts grow with the questions: they meet by their number, and are not sent to every task
    own = asked.join(part.hint("merge"), "true_part").join(kb, "kq").select("id", "question", (F.col("entry_id") + F.when(F.col("id") % 10 == 0, 1).otherwise(0)).alias("entry_id"))
    return E.roundtrip_report(own, K.find_matches(own.select("id", "question"), projection(s, d, "match_kb"), min_score=100, dictionary=PT.dictionary(s, d)))


register("e6_roundtrip_report", _roundtrip, PT.MATCHED + """, own AS (SELECT q.id, q.question, e.id + CASE WHEN q.id % 10 = 0 THEN 1 ELSE 0 END AS entry_id FROM match_questions q JOIN part p ON p.p_partkey = q.true_part JOIN match_kb e ON e.question = 'about the ' || p_name),
ms AS (SELECT question, entry_id, score, place FROM every WHERE score >= 100 AND place <= 5), bs AS (SELECT question, max(score) AS best FROM ms GROUP BY 1), tp AS (SELECT question, best, list(entry_id ORDER BY place) AS l FROM ms JOIN bs USING (question) WHERE score = best GROUP BY 1, 2),
bu AS (SELECT own.id, own.entry_id, CASE WHEN list_contains(l, own.entry_id) AND len(l) = 1 THEN 'top' WHEN list_contains(l, own.entry_id) THEN 'tied' WHEN (own.question, own.entry_id) IN (SELECT (question, entry_id) FROM ms) THEN 'listed' ELSE 'missing' END AS bucket,
  coalesce(best, 0) AS score, list_filter(l, lambda x: x <> own.entry_id)[1] AS top_entry FROM own LEFT JOIN tp ON tp.question = own.question)
SELECT *, max(bucket <> 'top') OVER (PARTITION BY entry_id) AS needs_review FROM bu""", _WORDS_AND_BASE)


#: Texts with everything that files must bring back whole.
_HARD = """SELECT id, keyword, sub_keyword, CASE id % 4 WHEN 0 THEN concat(question, ', "quoted"') WHEN 1 THEN concat(question, chr(10), 'next line') WHEN 2 THEN concat('it', chr(92), chr(39), 's ', question) ELSE question END AS question, response, category_id, status, hits FROM knowledge"""


def _hard(s, d):
    projection(s, d, "knowledge").createOrReplaceTempView("knowledge")
    return s.sql(_HARD)


def _read_back(s, d):
    path = S.scratch(s)
    columns = S.schema_of("knowledge").names
    df = _hard(s, d)
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(S.schema_of("knowledge")[c].dataType).alias(c) for c in columns)).write.parquet(path)
    return S.read_table(s, path, "knowledge", unescape=True).select("id", "keyword", "question", "status", "hits")


register("s1_read_table", _read_back, f", h AS ({_HARD}) SELECT id, keyword, replace(question, chr(92) || '''', '''') AS question, status, hits FROM h", "knowledge")


#: What each section is measured by when it is read back.
_MEASURED = {"knowledge": "question", "categories": "name", "synonyms": "misspellings", "stopwords": "word", "sources": "title", "chunks": "content"}


def _bundle(s, d):
    path = S.scratch(s)
    part = table(s, d, "part")
    synonyms = S.legacy_synonyms(part.selectExpr("p_partkey as ord", "split(p_name, ' ')[0] as misspelling", "upper(split(p_name, ' ')[1]) as canonical"))
    stopwords = table(s, d, "nation").selectExpr("lower(n_name) as word", "1 as is_active")
    chunks = projection(s, d, "chunks").withColumn("word_count", F.size(F.split("content", " ")))
    S.export_bundle({"knowledge": _hard(s, d), "categories": projection(s, d, "categories"), "synonyms": synonyms, "stopwords": stopwords, "sources": projection(s, d, "sources"), "chunks": chunks}, path)
    sizes = s.read.json(f"{path}/manifest").select("section", "n_rows")
    read = None
    for section, c in _MEASURED.items():
        rows = s.read.json(f"{path}/{section}").agg(F.lit(section).alias("section"), F.sum(F.length(c)).alias("n"), F.count_distinct(F.xxhash64(c)).alias("different"))
        read = rows if read is None else read.union(rows)
    return sizes.join(read, "section", "left")


register("s2_export_bundle_json", _bundle, f""", h AS ({_HARD}), f AS (SELECT lower(split_part(p_name, ' ', 2)) AS c, lower(split_part(p_name, ' ', 1)) AS m, min(p_partkey) AS ord FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2) GROUP BY 1, 2),
y AS (SELECT c, string_agg(m, ',' ORDER BY ord) AS misspellings FROM f GROUP BY 1),
a AS (SELECT 'knowledge' AS section, question AS t FROM h UNION ALL SELECT 'chunks', text FROM documents UNION ALL SELECT DISTINCT 'sources', source FROM documents UNION ALL SELECT 'categories', n_name FROM nation UNION ALL SELECT 'stopwords', lower(n_name) FROM nation UNION ALL SELECT 'synonyms', misspellings FROM y)
SELECT section, count(*) AS n_rows, sum(length(t))::BIGINT AS n, count(DISTINCT t) AS different FROM a GROUP BY 1""", "knowledge")


def _csv(s, d):
    """What the exporter writes, read by the importer."""
    path = S.scratch(s)
    S.export_csv(_hard(s, d), path, mark=True)
    rows, _ = S.import_csv_validated(s, path, ["id", "keyword", "question"])
    return rows.select(F.col("id").cast("long").alias("id"), "keyword", "question", "status", F.col("hits").cast("int").alias("hits"))


register("s3_export_knowledge_csv", _csv, f", h AS ({_HARD}) SELECT id, keyword, question, status, hits FROM h", "knowledge")


def _imported(s, d):
    path = S.scratch(s)
    k = projection(s, d, "knowledge")
    value = F.concat(F.lit('"'), F.regexp_replace(F.concat("response", F.lit('\n"and", so on')), '"', '""'), F.lit('"'))
    line = F.concat_ws(",", "id", "keyword", value, F.when(F.col("id") % 5 == 0, "odd").otherwise(F.col("status")))
    line = F.when(F.col("id") % 11 == 0, F.concat(line, F.lit(",one too many"))).when(F.col("id") % 13 == 0, "").otherwise(line)
    # every task's file begins with the header
    begins = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    k.select(F.concat(F.when(begins, "ID, Keyword ,RESPONSE,Status\n").otherwise(""), line).alias("value")).write.text(path)
    good, bad = S.import_csv_validated(s, path, ["keyword", "response"])
    return good.select(F.col("id").cast("long").alias("id"), "keyword", "response", "status").unionAll(bad.agg(F.count("*").alias("id")).select("id", F.lit("bad lines"), F.lit(None), F.lit(None)))


register("s6_import_csv_validated", _imported, """SELECT id, keyword, response || chr(10) || '"and", so on' AS response, CASE WHEN id % 5 = 0 THEN 'active' ELSE status END AS status FROM knowledge WHERE id % 11 > 0 AND id % 13 > 0
UNION ALL SELECT count(*), 'bad lines', NULL, NULL FROM knowledge WHERE id % 11 = 0""", "knowledge")
