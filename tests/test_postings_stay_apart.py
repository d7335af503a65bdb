"""Postings and asked terms take little room as files and much in memory: no join may send them through the driver. A chunk's part of its score."""

from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import fulltext as FT


def sent(df) -> list[str]:
    """The scans that feed a broadcast without a shuffle or sum before it."""
    found, at = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if at is not None and depth <= at:
            at = None
        if "BroadcastExchange" in line:
            at = depth
        elif at is not None and ("Exchange hash" in line or "Aggregate" in line):
            at = None
        elif at is not None and "FileScan" in line:
            found.append(line)
    return found


def test_postings_are_not_broadcast(spark):
    chunks = spark.createDataFrame([(i, i % 3, f"alpha w{i % 5}x w{i % 7}y") for i in range(60)], "chunk_id long, source_id long, content string")
    queries = spark.createDataFrame([(i, f"alpha w{i}x w{i}y") for i in range(5)], "query_id long, query string")
    asked, held = FT.index(chunks, queries)
    pairs = queries.select("query_id").crossJoin(chunks.select("chunk_id"))
    for df in (FT.candidates(asked, held, 5), FT.scored(pairs, asked, held), FT.fulltext_topk(chunks, queries, 5), FT.fulltext_in_sources(chunks, queries, queries.select("query_id").crossJoin(chunks.select("source_id").distinct()))):
        assert df.count() and not sent(df)


def test_a_chunk_is_looked_through_once(spark):
    texts = ["You MUST apply; gpa of 3, if you fail or who fail to. Apply2you", "", "x\u00e9minimum at least a1b2c3", None, "who do not meet if you do not required requires requirement minimum eligible"]
    questions = ["can you apply with gpa", "MUSTmust a1b2 c3", "", "minimum \u00e9min you2"]
    rows = spark.createDataFrame([(c, q) for c in texts for q in questions], "c string, q string")
    body = T.answer_body(F.col("c"))
    apart = 2 * T.terms_held(body["runs"], T.search_terms(F.col("q"))) + body["signs"]
    got = rows.select(apart.alias("apart"), T.score_for_question(F.col("c"), F.col("q")).alias("whole")).collect()
    assert all(r["apart"] == r["whole"] for r in got) and len({r["whole"] for r in got}) > 5
