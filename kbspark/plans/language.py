"""Registered stemming and spelling, with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import language as L
from kbspark.plans.fixtures import projection, table, with_projections
from kbspark.plans.text import ENDED

QUERIES: dict = {}
ORACLES: dict = {}


def _dictionary(s, d):
    words = table(s, d, "part").select(F.col("p_partkey").alias("ord"), F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.min("ord").alias("ord"))


def _tokens(s, d):
    return projection(s, d, "match_questions").select(F.explode(F.split(F.lower("question"), "[^a-z]+")).alias("token")).where("token <> ''")


def _forms(s, d):
    """The questions' tokens, and forms of the dictionary's words."""
    made = _dictionary(s, d).select(F.explode(F.array(*(F.concat("word", F.lit(e)) for e in ("s", "es", "ed", "ing", "ly")))).alias("token"))
    return _tokens(s, d).union(made)


QUERIES["t7_stem_token"] = lambda s, d: L.stem_tokens(_forms(s, d), _dictionary(s, d), s.createDataFrame([("dont", "do")], "form string, base string"))
_SQL = """, dict AS (SELECT word, min(ord) AS ord FROM (SELECT p_partkey AS ord, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1),
q AS (SELECT DISTINCT t AS token FROM (SELECT unnest(string_split_regex(lower(question), '[^a-z]+')) AS t FROM match_questions) WHERE t <> '')"""
#: (token, stem) as st for the tokens of f, by the words of dict.
STEMS = """c AS (SELECT token, CASE WHEN length(token) <= 3 THEN [] WHEN token LIKE '%ing' THEN [CASE WHEN token[-4] = token[-5] THEN token[:-5] ELSE token[:-4] || 'e' END] WHEN token LIKE '%ed' THEN [CASE WHEN token[-3] = token[-4] THEN token[:-4] ELSE token[:-3] END]
  WHEN token LIKE '%er' THEN [token[:-3]] WHEN token LIKE '%est' THEN [token[:-4]] WHEN token LIKE '%ly' THEN [token[:-3]] WHEN token LIKE '%ies' THEN [token[:-4] || 'y'] WHEN token LIKE '%es' THEN [token[:-3], token[:-3] || 'e'] WHEN token LIKE '%s' THEN [token[:-2]] ELSE [] END AS l FROM f),
u AS (SELECT token, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM c),
m AS (SELECT token, arg_min(x, i) AS s FROM u WHERE x IN (SELECT word FROM dict) OR (x LIKE 're%' AND x[3:] IN (SELECT word FROM dict)) GROUP BY 1),
st AS (SELECT c.token, coalesce(m.s, c.token) AS stem FROM c LEFT JOIN m ON m.token = c.token)"""
ORACLES["t7_stem_token"] = with_projections("match_questions", _SQL + f""",
f AS (SELECT token FROM q UNION SELECT word || unnest(['s', 'es', 'ed', 'ing', 'ly']) FROM dict), {STEMS}
SELECT token, CASE WHEN token = 'dont' THEN 'do' ELSE stem END AS stem FROM st""")
def _misspelt(s, d):
    """The questions' tokens, and the dictionary's words with one letter less, and with one changed and one more."""
    word = F.col("word")
    made = _dictionary(s, d).select(F.explode(F.array(F.concat(F.left(word, F.lit(1)), F.substr(word, F.lit(3))), F.concat(F.left(word, F.lit(2)), F.lit("z"), F.substr(word, F.lit(4)), F.lit("x")))).alias("token"))
    return _tokens(s, d).union(made)


QUERIES["t9_spell_correct"] = lambda s, d: L.spell_correct(_misspelt(s, d), _dictionary(s, d))
ORACLES["t9_spell_correct"] = with_projections("match_questions", _SQL + """,
m AS (SELECT token FROM q UNION SELECT left(word, 1) || substr(word, 3) FROM dict UNION SELECT left(word, 2) || 'z' || substr(word, 4) || 'x' FROM dict),
n AS (SELECT token, word, ord, levenshtein(token, word) AS distance FROM m JOIN dict ON levenshtein(token, word) BETWEEN 1 AND CASE WHEN length(token) >= 6 THEN 2 ELSE 1 END
  WHERE length(token) > 2 AND regexp_matches(token, '[aeiouy]') AND token NOT IN (SELECT word FROM dict) AND token NOT IN (ENDED)),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, ord, word) AS k FROM n) SELECT token, word AS correction, distance::INTEGER AS distance FROM r WHERE k = 1""".replace("ENDED", ENDED.format("dict")))
