"""Pruned full-text search against plain Python, and how many chunks it looks at."""

import math
import random
import re
from collections import Counter

import pytest

from kbspark.operators import fulltext


def plain(chunks, queries, k):
    held = {i: Counter(re.findall(r"[^\W_]{3,}", (t or "").lower())) for i, t in chunks}
    df = Counter(w for c in held.values() for w in c)
    out = []
    for q, text in queries:
        asked = set(re.findall(r"[^\W_]{3,}", (text or "").lower()))
        scores = [(-round(sum(c[w] * math.log10(len(chunks) / df[w]) ** 2 for w in asked if c[w]), 6), i) for i, c in held.items()]
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out)


def corpus(rnd, n, words=400):
    vocabulary = [f"w{i:03d}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([5, 40, 40, 300])))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 5, 20])
def test_same_as_plain(spark, k):
    rnd = random.Random(k)
    chunks = corpus(rnd, 300) + [(1000, None), (1001, ""), (1002, "w001 w399 w399"), (1003, "w001 w399 w399")]
    queries = [(i, " ".join(rnd.choices([f"w{j:03d}" for j in range(400)], k=rnd.randrange(1, 25)))) for i in range(30)] + [(90, None), (91, "absent"), (92, "w000"), (93, "w399 W399 w001")]
    got = fulltext.fulltext_topk(spark.createDataFrame(chunks, "chunk_id long, content string"), spark.createDataFrame(queries, "query_id long, query string"), k)
    got = sorted((r["query_id"], r["chunk_id"], round(r["relevance"], 6), r["rank"]) for r in got.collect())
    want = plain(chunks, queries, k)
    assert [(q, i, n) for q, i, _, n in got] == [(q, i, n) for q, i, _, n in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))


def test_candidates_do_not_grow_with_the_chunks(spark):
    rnd = random.Random(1)
    queries = spark.createDataFrame([(i, " ".join(rnd.choices([f"w{j:03d}" for j in range(60)], k=12))) for i in range(20)], "query_id long, query string")
    seen = []
    for n in (800, 8000):
        asked, held = fulltext.index(spark.createDataFrame(corpus(random.Random(2), n), "chunk_id long, content string"), queries)
        seen.append((fulltext.candidates(asked, held, 5).count() / 20, asked.join(held, "term").select("query_id", "chunk_id").distinct().count() / 20))
    (few, all_few), (many, all_many) = seen
    assert all_many > 9 * all_few and many < 5 * few and many < 0.02 * all_many
