"""r9: every source is asked, and a source's best chunks are those that all of its postings give."""

import math
import random
import re
from collections import Counter

from kbspark import plans
from kbspark.operators import fulltext as FT
from kbspark.plans.fixtures import projection, table

FOLDER = "/root/testdata/sf0.001"


def test_every_source(spark):
    pairs = table(spark, FOLDER, "benchmark").count() * projection(spark, FOLDER, "sources").where("status = 'indexed'").count()
    assert plans.queries()["r9_best_chunk_for_question"](spark, FOLDER).select("query_id", "source_id").distinct().count() == pairs


def test_top_of_a_source(spark):
    r = random.Random(5)
    words = [f"w{i}x" for i in range(30)]
    text = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(30)], k=n))
    chunks = [(i, i % 4, text(r.randint(0, 60))) for i in range(400)]
    queries = [(i, text(6)) for i in range(12)] + [(12, "nothing")]
    pairs = [(q, s) for q, _ in queries for s in range(5)]
    terms = {c: Counter(re.findall(r"[a-z0-9]{3,}", t)) for c, _, t in chunks}
    df = Counter(t for x in terms.values() for t in x)
    want = set()
    for q, t in queries:
        asked = set(re.findall(r"[a-z0-9]{3,}", t))
        for s in range(5):
            of = {c: round(sum(terms[c][w] * math.log10(len(chunks) / df[w]) ** 2 for w in asked if terms[c][w]), 6) for c, source, _ in chunks if source == s}
            best = sorted((-v, c) for c, v in of.items() if v > 0)[:5]
            want |= {(q, s, c, -v, n + 1) for n, (v, c) in enumerate(best)}
    made = [spark.createDataFrame(rows, schema) for rows, schema in ((chunks, "chunk_id long, source_id long, content string"), (queries, "query_id long, query string"), (pairs, "query_id long, source_id long"))]
    assert {tuple(x) for x in FT.fulltext_in_sources(*made).collect()} == want
