"""Registered indexing, retrieval and citation queries, with independent SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import text as X
from kbspark.operators import fulltext as FT
from kbspark.operators import indexing as I
from kbspark.operators import retrieval as R
from kbspark.operators import vectors as V
from kbspark.plans.fixtures import projection, table, with_projections
from kbspark.sources.tables import written

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, f, sql: str | None = None, tables: str = ""):
    QUERIES[name] = f
    if sql:
        ORACLES[name] = with_projections(tables, sql) if tables else sql.strip()


def _pages(s, d):
    return table(s, d, "pages")


def _page_texts(s, d):
    return _pages(s, d).select(F.col("page_id").alias("source_id"), I.html_to_text(F.col("html")).alias("text"))


register("i1_html_to_text", lambda s, d: _page_texts(s, d))
register("i2_html_title", lambda s, d: _pages(s, d).select("page_id", I.html_title(F.col("html")).alias("title")), """
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""")


def _linked(s, d):
    """Pages with links of every kind to their own and other sites before them."""
    links = "<a href=\"/own/{0}?x=1#top\">a</a><a class='b' href='next{0}.html'>b</a><a href=\"mailto:a@b.c\">c</a><a href=\"http://elsewhere.example/{0}\">d</a><a href=\"/file{0}.pdf\">e</a><a href=\"/own/{0}?x=1\">f</a>"
    return _pages(s, d).withColumn("html", F.concat(F.lit("<main>"), F.replace(F.lit(links), F.lit("{0}"), F.col("page_id").cast("string")), F.lit("</main>"), "html"))


register("i3_extract_links", lambda s, d: I.extract_links(_linked(s, d)), """
WITH p AS (SELECT url, page_id, regexp_extract(url, '^[^:]+://[^/?#]+') AS root, regexp_extract(url, '^([^:]+://[^?#]*/)', 1) AS folder FROM pages), k AS (SELECT page_id, root || '/own/' || page_id || '?x=1' AS link FROM p UNION ALL SELECT page_id, folder || 'next' || page_id || '.html' FROM p)
SELECT DISTINCT page_id, link FROM k""")
def _graph(s, d):
    """Orders link to their parts; of every second link the url is written in another way. A crawl starts from each nation's number."""
    site = F.lit("https://site.example/")
    odd = F.concat(F.lit("HTTPS://Site.Example:443/"), F.col("l_partkey"), F.lit("/#part"))
    link = F.when(F.col("l_linenumber") % 2 == 0, odd).otherwise(F.concat(site, "l_partkey"))
    links = table(s, d, "lineitem").select(F.concat(site, "l_orderkey").alias("url"), link.alias("link"), F.col("l_linenumber").alias("place"))
    pages = table(s, d, "part").where("p_size % 11 <> 0").select(F.concat(site, "p_partkey").alias("url"))
    seeds = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("job"), F.concat(site, F.col("n_nationkey") + 1).alias("url"))
    return links, seeds, pages


register("i4_crawl_frontier", lambda s, d: I.crawl_frontier(*_graph(s, d), most=12), """
WITH l AS (SELECT l_orderkey AS url, l_partkey AS link, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2), p AS (SELECT p_partkey AS url FROM part WHERE p_size % 11 <> 0),
s AS (SELECT n_nationkey AS job, n_nationkey + 1 AS url, 0 AS depth, 1 AS place FROM nation WHERE n_nationkey + 1 IN (SELECT url FROM p)),
a AS (SELECT job, url, 1 AS depth, 1 + count(*) OVER (PARTITION BY job ORDER BY first, url::VARCHAR) AS place FROM (
  SELECT s.job, l.link AS url, min((place, pos)) AS first FROM s JOIN l USING (url) WHERE l.link IN (SELECT url FROM p) AND l.link <> s.url GROUP BY 1, 2)),
f AS (SELECT * FROM s UNION ALL SELECT * FROM a WHERE place <= 12), n AS (SELECT job, max(place) AS taken FROM f GROUP BY 1),
b AS (SELECT job, url, 2 AS depth, taken + count(*) OVER (PARTITION BY job ORDER BY first, url::VARCHAR) AS place FROM (
  SELECT a.job, l.link AS url, min((place, pos)) AS first FROM a JOIN l USING (url) WHERE a.place <= 12 AND l.link IN (SELECT url FROM p) AND (a.job, l.link) NOT IN (SELECT (job, url) FROM f) GROUP BY 1, 2) JOIN n USING (job))
SELECT job::BIGINT AS job, 'https://site.example/' || url AS url, depth, place::INTEGER AS place FROM (SELECT * FROM f UNION ALL SELECT * FROM b WHERE place <= 12)""")
register("i5_chunk_text", lambda s, d: I.chunk_text(_page_texts(s, d)))
register("i6_incremental_reindex", lambda s, d: I.reindex_plan(table(s, d, "documents").select(F.col("doc_id").alias("source_id"), "text"), _stored(s, d)), """
WITH c AS (SELECT doc_id AS source_id, trim(text, ' ') AS t FROM documents), w AS (SELECT doc_id AS source_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE sha256(trim(text, ' ')) END AS was FROM documents WHERE doc_id % 5 > 0)
SELECT c.source_id, sha256(t) AS content_hash, CASE WHEN t = '' THEN 'error' WHEN was IS NULL THEN 'new' WHEN was = sha256(t) THEN 'unchanged' ELSE 'changed' END AS action FROM c LEFT JOIN w ON w.source_id = c.source_id""")


def _stored(s, d):
    return table(s, d, "documents").where("doc_id % 5 > 0").select(F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.sha2(F.trim("text"), 256)).alias("content_hash"))


register("i7_source_stats", lambda s, d: I.source_stats(projection(s, d, "chunks").select("source_id", X.word_count(F.col("content")).alias("word_count"))), """
SELECT source_id, count(*) AS chunk_count, sum(len(regexp_extract_all(content, '[\\p{L}''\\-]+')))::BIGINT AS word_count FROM chunks GROUP BY 1""", "chunks")
register("i8_register_sources", lambda s, d: I.register_sources(_pages(s, d).select("url"), _pages(s, d).where("page_id % 2 = 0").select("url", F.when(F.col("page_id") % 4 == 0, "error").otherwise("indexed").alias("status"))), """
WITH n AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+(\\?|$)', '\\1') AS url FROM pages), k AS (SELECT url, max(CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END) AS again FROM n WHERE page_id % 2 = 0 GROUP BY 1)
SELECT DISTINCT n.url, CASE WHEN again IS NULL THEN 'insert' WHEN again = 1 THEN 'reindex' ELSE 'skip' END AS action FROM n LEFT JOIN k ON k.url = n.url""")
register("d1_near_duplicate_questions", lambda s, d: I.near_duplicate_questions(projection(s, d, "match_questions"), 0.6), """
, k AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(question), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM match_questions), t AS (SELECT k, list_distinct(string_split(k, ' ')) AS t FROM k),
p AS (SELECT a.k AS a, b.k AS b, len(list_intersect(a.t, b.t))::DOUBLE AS n, len(a.t) + len(b.t) AS m FROM t a JOIN t b ON a.k < b.k)
SELECT a, b, n / (m - n) AS similarity FROM p WHERE n / (m - n) >= 0.6""", "match_questions")


def _chunks(s, d):
    """The chunks of indexed sources."""
    indexed = projection(s, d, "sources").where("status = 'indexed'").select(F.col("id").alias("source_id"))
    # a row a source; by size Spark would deal out all texts by source
    return projection(s, d, "chunks").join(F.broadcast(indexed), "source_id", "left_semi").select(F.col("id").alias("chunk_id"), "source_id", "chunk_index", "content")


def _asked(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _full(s, d):
    """What every query here that starts from the full text's lists reads: written, as most of them read it more than once."""
    return written(FT.fulltext_topk(_chunks(s, d), _asked(s, d)))


_FULL = """, ic AS (SELECT * FROM chunks WHERE source_id IN (SELECT id FROM sources WHERE status = 'indexed')),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{3,}')) AS term FROM benchmark),
p AS (SELECT id AS chunk_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]{3,}')) AS term FROM ic), h AS (SELECT term, chunk_id, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, pow(log10((SELECT count(*) FROM ic)::DOUBLE / count(*)), 2) AS weight FROM h GROUP BY 1),
f AS (SELECT query_id, chunk_id, round(sum(tf * weight), 6) AS relevance FROM q JOIN w USING (term) JOIN h USING (term) GROUP BY 1, 2),
ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id)::INTEGER AS rank FROM f WHERE relevance > 0) WHERE rank <= 20)"""
register("r1_fulltext_topk", lambda s, d: FT.fulltext_topk(_chunks(s, d), _asked(s, d)), _FULL + " SELECT * FROM ft", "chunks sources")


def _vectors(s, d):
    rows = projection(s, d, "vector_chunks").where("content_type = 'chunk' and (source_namespace = 'source' or source_namespace is null) and is_current")
    return V.vector_topk(rows.select(F.col("content_id").alias("chunk_id"), "embedding"), projection(s, d, "vector_queries"))


def _recall(s, d):
    """Of each query's 20 nearest, how many the inverted lists find; with all lists probed all of them."""
    rows = projection(s, d, "vector_chunks").where("content_type = 'chunk' and is_current").select(F.col("content_id").alias("chunk_id"), "embedding")
    asked = projection(s, d, "vector_queries")
    exact = V.vector_topk(rows, asked).select("query_id", "chunk_id")
    lists = V.learn_lists(rows, 64)
    found = V.vector_ann(rows, asked, lists=64, probes=44, centres=lists).select("query_id", "chunk_id", F.lit(1).alias("found"))
    every = V.vector_ann(rows, asked, lists=64, probes=64, centres=lists).select("query_id", "chunk_id", F.lit(1).alias("every"))
    out = exact.join(found, ["query_id", "chunk_id"], "left").join(every, ["query_id", "chunk_id"], "left")
    out = out.groupBy("query_id").agg(F.count("*").alias("nearest"), F.count("found").alias("found"), F.count("every").alias("every"))
    return out.agg(F.count("*").alias("queries"), F.sum("nearest").alias("nearest"), F.sum("every").alias("every"), (F.sum("found") >= 0.9 * F.sum("nearest")).alias("enough"))


_VECTOR = """, v AS (SELECT query_id, content_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity FROM vector_queries q JOIN vector_chunks c
  ON content_type = 'chunk' AND (source_namespace = 'source' OR source_namespace IS NULL) AND is_current),
vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INTEGER AS rank FROM v) WHERE rank <= 20)"""
register("r2_vector_ann", _recall, """, q AS (SELECT count(*) AS n FROM vector_queries), v AS (SELECT count(*) AS n FROM vector_chunks WHERE content_type = 'chunk' AND is_current)
SELECT q.n AS queries, (q.n * least(20, v.n))::BIGINT AS nearest, (q.n * least(20, v.n))::BIGINT AS every, true AS enough FROM q, v""", "vector_queries vector_chunks")
register("r2_vector_topk", _vectors, _VECTOR + " SELECT * FROM vt", "vector_queries vector_chunks")


def _both(s, d, full=None):
    """Two lists for the same queries: the benchmark's texts by terms, and as vectors those of the same number."""
    full = (_full(s, d) if full is None else full).select("query_id", "chunk_id", "relevance", "rank")
    vector = written(_vectors(s, d).withColumn("query_id", (F.col("query_id") / 50).cast("long")))  # every vector met every query for it
    return vector, full


_BOTH = _FULL + _VECTOR.replace("SELECT query_id, content_id", "SELECT query_id // 50 AS query_id, content_id") + """,
u AS (SELECT query_id, chunk_id, rank, 0 AS l FROM vt UNION ALL SELECT query_id, chunk_id, rank, 1 FROM ft),
g AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, min(l * 1000 + rank) AS first FROM u GROUP BY 1, 2),
r AS (SELECT query_id, chunk_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first)::INTEGER AS rank FROM g)"""
register("r3_rrf_merge", lambda s, d: R.rrf_merge(*_both(s, d)), _BOTH + " SELECT * FROM r", "chunks sources vector_queries vector_chunks")
_HYBRID = _BOTH + """, z AS (SELECT query_id FROM vt GROUP BY 1 HAVING max(similarity) <= 0.35),
hy AS (SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + rank), 6) AS relevance, rank FROM r WHERE rank <= 6 AND query_id NOT IN (SELECT query_id FROM z))"""
register("r4_hybrid_retrieve", lambda s, d: R.hybrid_retrieve(*_both(s, d)), _HYBRID + " SELECT * FROM hy", "chunks sources vector_queries vector_chunks")
register("r4_retrieval_diagnostics", lambda s, d: R.diagnostics(*_both(s, d)), _BOTH + """
SELECT query_id, coalesce(vc, 0) AS vector_count, coalesce(tc, 0) AS fulltext_count, top_similarity, coalesce(oc, 0)::INTEGER AS overlap_count, coalesce(top_similarity <= 0.35, false) AS gate_fired
FROM (SELECT query_id, count(*) AS vc, max(similarity) AS top_similarity FROM vt GROUP BY 1) FULL JOIN (SELECT query_id, count(*) AS tc FROM ft GROUP BY 1) USING (query_id)
LEFT JOIN (SELECT vt.query_id, count(*) AS oc FROM vt JOIN ft ON ft.query_id = vt.query_id AND ft.chunk_id = vt.chunk_id GROUP BY 1) o USING (query_id)""", "chunks sources vector_queries vector_chunks")
def _merged(s, d):
    full = _full(s, d)
    return R.merge_expanded(full, full.where("rank % 2 = 0").union(full.where("rank = 3").withColumn("chunk_id", -F.col("chunk_id"))))


register("r5_merge_expanded", _merged, _FULL + """
SELECT query_id, chunk_id, round(CASE WHEN rank % 2 = 0 THEN relevance + 1.2::DOUBLE * relevance ELSE relevance END, 6) AS relevance FROM ft UNION ALL SELECT query_id, -chunk_id, relevance FROM ft WHERE rank = 3""", "chunks sources")


_INDEXED = ", ic AS (SELECT * FROM chunks WHERE source_id IN (SELECT id FROM sources WHERE status = 'indexed'))"
_LIKE = """
lw AS (SELECT DISTINCT item_id AS query_id, unnest([x FOR x IN regexp_split_to_array(lower(text), '[^0-9A-Za-z_]+') IF length(x) >= 4][1:5]) AS w FROM benchmark),
lm AS (SELECT DISTINCT query_id, id AS chunk_id FROM lw JOIN ic ON contains(lower(content), w)), lk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id)::INTEGER AS rank FROM lm)"""
register("r6_like_fallback", lambda s, d: R.like_fallback(_chunks(s, d), _asked(s, d)), _INDEXED + "," + _LIKE + " SELECT * FROM lk WHERE rank <= 20", "chunks sources")


def _short(s, d):
    """The benchmark's texts, every seventh of which has no word of four letters."""
    return _asked(s, d).withColumn("query", F.when(F.col("query_id") % 7 == 0, "how is it").otherwise(F.col("query")))


register("r7_simple_retrieve", lambda s, d: R.simple_retrieve(_chunks(s, d), _short(s, d)), _INDEXED + """,
w AS (SELECT DISTINCT item_id AS query_id, unnest([x FOR x IN string_split_regex(lower(text), '\\s+') IF length(x) >= 4][1:5]) AS w FROM benchmark WHERE item_id % 7 <> 0), m AS (SELECT DISTINCT query_id, id AS chunk_id FROM w JOIN ic ON contains(lower(content), w)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS k FROM m), t AS (SELECT id FROM ic ORDER BY id DESC LIMIT 5)
SELECT query_id, chunk_id FROM n WHERE k <= 5 UNION ALL SELECT item_id, t.id FROM benchmark, t WHERE item_id % 7 = 0""", "chunks sources")

_WORDS = "[x FOR x IN string_split_regex(lower(content), '[^\\p{L}]+') IF length(x) >= 4 AND x NOT IN (STOP)]".replace("STOP", ", ".join(f"'{w}'" for w in X.STOPWORDS))
_CONTACT = """, hc AS (SELECT query_id, chunk_id, source_id, content FROM h0 JOIN ic ON ic.id = h0.chunk_id), tw AS (SELECT query_id, w FROM (SELECT query_id, unnest(WORDS) AS w FROM hc) GROUP BY 1, 2 HAVING count(*) >= 2),
ct AS (SELECT id AS chunk_id, source_id, content FROM ic WHERE regexp_matches(content, '\\(?\\d{3}\\)?[\\s.\\-]\\d{3}[\\s.\\-]\\d{4}|[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}|https?://[^\\s]+')
  OR regexp_matches(content, '(?i)(room|building|suite|floor|hall|center)\\s+\\w+|(hours?|monday|tuesday|wednesday|thursday|friday|open|closed).*\\d{1,2}:\\d{2}|contact|reach|call|email|phone|fax|location|address|visit us|stop by|p\\.?o\\.?\\s*box')),
cw AS (SELECT DISTINCT chunk_id, unnest(WORDS) AS w FROM ct), cs AS (SELECT query_id, chunk_id, count(*) AS n FROM cw JOIN tw USING (w) GROUP BY 1, 2),
sp AS (SELECT DISTINCT query_id, ct.chunk_id FROM hc JOIN ct ON ct.source_id = hc.source_id), sc AS (SELECT query_id, chunk_id, coalesce(n, 0) + CASE WHEN sp.query_id IS NOT NULL THEN 10 ELSE 0 END AS score FROM cs FULL JOIN sp USING (query_id, chunk_id)),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS k FROM sc ANTI JOIN h0 USING (query_id, chunk_id)),
cc AS (SELECT query_id, chunk_id, score::BIGINT AS score, k FROM cr WHERE k <= 2)""".replace("WORDS", _WORDS)
register("r8_contact_chunks", lambda s, d: R.contact_chunks(_chunks(s, d), R.hybrid_retrieve(*_both(s, d), gate=-1.0)), _BOTH + ", h0 AS (SELECT query_id, chunk_id FROM r WHERE rank <= 6)" + _CONTACT + " SELECT query_id, chunk_id, score FROM cc", "chunks sources vector_queries vector_chunks")


def _pairs(s, d):
    """Each benchmark text with every indexed source, some with a hint."""
    sources = projection(s, d, "sources").where("status = 'indexed'").select(F.col("id").alias("source_id"))
    return _asked(s, d).select("query_id", F.when(F.col("query_id") % 3 == 0, F.col("query_id")).alias("hint")).crossJoin(F.broadcast(sources))


register("r9_best_chunk_for_question", lambda s, d: R.best_chunks(_chunks(s, d), _asked(s, d), _pairs(s, d)), _FULL + """,
pr AS (SELECT item_id AS query_id, id AS source_id, CASE WHEN item_id % 3 = 0 THEN item_id END AS hint, text FROM benchmark, sources WHERE status = 'indexed'),
nr AS (SELECT f.query_id, ic.source_id, chunk_id, content, text, row_number() OVER (PARTITION BY f.query_id, ic.source_id ORDER BY relevance DESC, chunk_id) AS k FROM f JOIN ic ON ic.id = f.chunk_id JOIN pr ON pr.query_id = f.query_id AND pr.source_id = ic.source_id WHERE relevance > 0),
sr AS (SELECT query_id, source_id, chunk_id, k, 2 * len([t FOR t IN list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) IF length(t) >= 3 AND t NOT IN (QW) AND contains(lower(content), t)])
  + 3 * least(4, len([x FOR x IN [SIGNALS] IF contains(lower(content), x)])) - CASE WHEN len([x FOR x IN [UNMET] IF contains(lower(content), x)]) >= 2 THEN 5 ELSE 0 END AS points FROM nr WHERE k <= 5),
br AS (SELECT query_id, source_id, arg_max(chunk_id, (points, -k)) AS best FROM sr GROUP BY 1, 2), fr AS (SELECT source_id, arg_min(id, (chunk_index, id)) AS first FROM ic GROUP BY 1)
SELECT pr.query_id, pr.source_id, coalesce(best, CASE WHEN hint IN (SELECT id FROM ic) THEN hint END, first) AS chunk_id FROM pr LEFT JOIN br ON br.query_id = pr.query_id AND br.source_id = pr.source_id LEFT JOIN fr ON fr.source_id = pr.source_id"""
    .replace("QW", ", ".join(f"'{w}'" for w in X.QUESTION_WORDS)).replace("SIGNALS", ", ".join(f"'{w}'" for w in X.ANSWER_SIGNALS)).replace("UNMET", ", ".join(f"'{w}'" for w in X.UNMET)), "chunks sources")


def _found(s, d):
    """An expanded query finds, here, the full text's list at every other place."""
    full = _full(s, d)
    expanded = full.where("rank % 2 = 0").select("query_id", "chunk_id", "relevance")
    return R.find_relevant_chunks(_chunks(s, d), _asked(s, d), R.hybrid_retrieve(*_both(s, d, full)), full, expanded)


register("r10_find_relevant_chunks", _found, _HYBRID + "," + _LIKE + """,
ex AS (SELECT query_id, chunk_id, round(CASE WHEN rank % 2 = 0 THEN relevance + 1.2::DOUBLE * relevance ELSE relevance END, 6) AS relevance FROM ft WHERE query_id NOT IN (SELECT query_id FROM hy)),
er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id)::INTEGER AS rank FROM ex),
h1 AS (SELECT query_id, chunk_id, 'hybrid' AS tier, rank FROM hy UNION ALL SELECT query_id, chunk_id, 'fulltext', rank FROM er WHERE rank <= 6), h0 AS (SELECT query_id, chunk_id FROM h1)""" + _CONTACT + """
SELECT * FROM h1 UNION ALL SELECT query_id, chunk_id, 'like', rank FROM lk WHERE rank <= 6 AND query_id NOT IN (SELECT query_id FROM h1) UNION ALL SELECT query_id, chunk_id, 'contact', k FROM cc""", "chunks sources vector_queries vector_chunks")


def _candidates(s, d):
    answers = table(s, d, "benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("answer"))
    best = written(FT.fulltext_topk(_chunks(s, d), _asked(s, d), 8))
    return best.select(F.col("query_id").alias("answer_id"), "chunk_id", F.col("rank").alias("position")).join(_chunks(s, d), "chunk_id").join(answers, "answer_id")


def _judged(rows):
    """A judge's scores for two answers of three, not for all of their sources."""
    rows = rows.where("answer_id % 3 > 0 and chunk_id % 4 > 0").select("answer_id", "source_id").distinct()
    return rows.withColumn("llm_score", F.pmod(F.col("answer_id") * 7 + F.col("source_id") * 3, F.lit(10)) / 10.0)


def _cited(s, d):
    rows = _candidates(s, d)
    return R.select_citations(rows, _judged(rows)).select("answer_id", "source_id", "chunk_id", "route", "used_in_answer")


_KEYED = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_PHRASES = f"list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1) IF len([x FOR x IN w[i:i + 2] IF NOT list_contains({_STOP}, x)]) >= 2])"
_ANSWER_WORDS = f"list_distinct([x FOR x IN w IF length(x) >= 4 AND NOT list_contains({_STOP}, x)])"


def _bare(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    for entity, char in X.ENTITIES.items():
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return out


_CITED = _FULL + f""", ca AS (SELECT query_id AS answer_id, ic.source_id, chunk_id, rank, content FROM ft JOIN ic ON ic.id = ft.chunk_id WHERE rank <= 8),
fs AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY rank)::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, source_id ORDER BY rank) AS k FROM ca WHERE source_id > 0) WHERE k = 1),
an AS (SELECT answer_id, {_PHRASES} AS ph, {_ANSWER_WORDS} AS wo FROM (SELECT item_id AS answer_id, string_split({_KEYED.format('text')}, ' ') AS w FROM benchmark)),
bo AS (SELECT chunk_id, {_KEYED.format(_bare('content'))} AS body FROM (SELECT DISTINCT chunk_id, content FROM fs)),
ov AS (SELECT fs.answer_id, fs.source_id, fs.chunk_id, fs.position, 5 * len([x FOR x IN ph IF contains(body, x)]) AS phrase_score, len([x FOR x IN wo IF contains(body, x)]) AS words FROM fs JOIN an USING (answer_id) JOIN bo USING (chunk_id))"""
register("c1_answer_phrases", lambda s, d: projection(s, d, "match_questions").select("id", F.array_join(F.sort_array(R.answer_phrases(F.col("question"))), "|").alias("phrases")), f"""
SELECT id, array_to_string(list_sort({_PHRASES}), '|') AS phrases FROM (SELECT id, string_split({_KEYED.format('question')}, ' ') AS w FROM match_questions)""", "match_questions")
register("c2_answer_words", lambda s, d: projection(s, d, "match_questions").select("id", F.array_join(R.answer_words(F.col("question")), "|").alias("words")), """
SELECT id, array_to_string(list_distinct_ordered, '|') AS words FROM (SELECT id, [x FOR x, i IN w IF list_position(w, x) = i] AS list_distinct_ordered FROM (
  SELECT id, [t FOR t IN string_split_regex(trim(regexp_replace(regexp_replace(lower(question), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')), '\\s+') IF length(t) >= 4 AND NOT list_contains(STOP, t)] AS w FROM match_questions))""".replace("STOP", "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"), "match_questions")
register("c3_overlap_score", lambda s, d: R.select_citations(_candidates(s, d)).select("answer_id", "chunk_id", "phrase_score", "overlap_score"), _CITED + " SELECT answer_id, chunk_id, phrase_score::INTEGER AS phrase_score, (phrase_score + words)::INTEGER AS overlap_score FROM ov", "chunks sources")
register("c4_select_citations", _cited, _CITED + """,
ju AS (SELECT DISTINCT answer_id, source_id, ((answer_id * 7 + source_id * 3) % 10) / 10.0::DOUBLE AS score FROM ca WHERE answer_id % 3 > 0 AND chunk_id % 4 > 0),
ro AS (SELECT *, CASE WHEN count(*) FILTER (phrase_score > 0) OVER (PARTITION BY answer_id) = 1 THEN 'heuristic' WHEN answer_id IN (SELECT answer_id FROM ju) THEN 'llm' ELSE 'fallback' END AS route FROM ov),
us AS (SELECT ro.*, CASE WHEN route = 'llm' THEN score END AS score, CASE WHEN route = 'llm' THEN coalesce(score >= 0.5, false) ELSE phrase_score >= 5 END AS used FROM ro LEFT JOIN ju USING (answer_id, source_id)),
pl AS (SELECT *, row_number() OVER (PARTITION BY answer_id, used ORDER BY score DESC NULLS LAST, phrase_score + words DESC, position) AS k FROM us)
SELECT answer_id, source_id, chunk_id, route, (used AND k <= 3)::INTEGER AS used_in_answer FROM pl""", "chunks sources")
register("c5_source_usage_rows", lambda s, d: _candidates(s, d).select("answer_id", "source_id").distinct(), _FULL + " SELECT DISTINCT query_id AS answer_id, source_id FROM ft JOIN ic c ON c.id = ft.chunk_id WHERE rank <= 8", "chunks sources")
