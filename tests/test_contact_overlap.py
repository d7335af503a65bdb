"""Contact chunks: what topics and chunks share is counted in blocks, in no row of its own; the faster test for contact details is the same."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from kbspark.functions import text as T
from kbspark.operators import overlap, retrieval, vectors


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("words", [2_000_000, 150])
def test_same_as_plain(spark, monkeypatch, words):
    monkeypatch.setattr(overlap, "WORDS", words)
    r = random.Random(words)
    vocabulary = [f"w{a}{b}x" for a in "abcdefgh" for b in "klm"] + ["email"]
    chunks = [(i, i % 5 if i % 9 else None, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(25)], k=r.randint(0, 12))) + r.choice(["", " call 12", " x@y.org"])) for i in range(120)] + [(200, 1, None), (201, 1, "fax")]
    retrieved = [(q, c) for q in range(12) for c in r.sample(range(125), r.randint(1, 6))] + [(90, 999), (91, 201)]
    text, source = {i: t for i, _, t in chunks}, {i: s for i, s, _ in chunks}
    took = lambda t: [w for w in re.split(r"[^a-z]+", t or "") if len(w) >= 4]
    want = set()
    for q in {q for q, _ in retrieved}:
        own = {c for x, c in retrieved if x == q and c in text}
        topic = {w for w, n in Counter(w for c in own for w in took(text[c])).items() if n >= 2}
        near = {source[c] for c in own} - {None}
        scores = [(-len(topic & set(took(t))) - 10 * (s in near), i) for i, s, t in chunks if re.search("call|@|email|fax", t or "") and i not in own]
        want |= {(q, i, -s) for s, i in sorted(x for x in scores if x[0] < 0)[:2]}
    made = retrieval.contact_chunks(spark.createDataFrame(chunks, "chunk_id long, source_id long, content string"), spark.createDataFrame(retrieved, "query_id long, chunk_id long"))
    assert {tuple(x) for x in made.collect()} == want and len(want) > 20
    assert "Generate explode(words" not in plan(made) and "FlatMapCoGroupsInArrow" in plan(made)


def test_nothing_to_find(spark):
    chunks = spark.createDataFrame([(1, 1, "plain")], "chunk_id long, source_id long, content string")
    for rows in ([], [(1, 1)]):
        assert retrieval.contact_chunks(chunks, spark.createDataFrame(rows, "query_id long, chunk_id long")).count() == 0


def test_has_contact_info(spark):
    r = random.Random(3)
    parts = ["CALL", "Visit us", "visit", " ", "\n", "(555) 123-4567", "555.123.4567", "55", "5551234567", "a.b@c.de", "@", "a@b", "https://", "HTTP://x", "http://x", "Room", "\t", "hall", "12", "Hours", ":", "9:30", "19:5", "OPEN", "P.O. BOX", "po box", "box", "\u212a", "\u0130", "emai\u0307l", "\u017f", "\u00e9", "locat", "ion", "fa", "x", "centre"]
    texts = [None, ""] + ["".join(r.choices(parts, k=r.randint(1, 5))) for _ in range(3000)]
    whole = "|".join(f"({x})" if not x.startswith("(?i)") else f"((?i:{x[4:]}))" for x in T.CONTACT.values())
    rows = spark.createDataFrame([(t,) for t in texts], "c string")
    got = rows.select(T.has_contact_info(rows["c"]).alias("new"), rows["c"].rlike(whole).alias("old")).collect()
    assert all(x["new"] == x["old"] for x in got) and 500 < sum(bool(x["new"]) for x in got) < 2900


def test_nearest_in_steps(monkeypatch):
    rnd = np.random.default_rng(1)
    monkeypatch.setattr(vectors, "STEP", 16)
    for n, k in ((0, 3), (2, 3), (15, 3), (16, 20), (50, 20), (300, 3), (300, 20)):
        m = rnd.integers(-1, 2, (n, 4)).astype(float)  # many ties
        m, q = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12), rnd.normal(size=(7, 4))
        keys, ids = rnd.permutation(n) * 3, np.arange(7) + 50
        s = np.round(q @ m.T, 9)
        want = [(50 + i, int(keys[j]), s[i, j]) for i in range(7) for j in np.lexsort((keys, -s[i]))[:k]]
        got = vectors.nearest(q, ids, m, keys, k)
        assert [(int(a), int(b)) for a, b, _ in zip(*got)] == [(a, b) for a, b, _ in want] and np.allclose(got[2], [x[2] for x in want], atol=1e-9)


def test_products_are_few_sorts(monkeypatch):
    rows = []
    sort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, **k: rows.append(np.size(keys[0])) or sort(keys, **k))
    monkeypatch.setattr(np, "partition", lambda a, *x, f=np.partition, **k: rows.append(np.size(a)) or f(a, *x, **k))
    rnd = np.random.default_rng(2)
    m, q = rnd.normal(size=(40 * vectors.STEP, 8)), rnd.normal(size=(50, 8))
    vectors.nearest(q, np.arange(50), m, np.arange(len(m)), 20)
    assert sum(rows) < 0.1 * 50 * len(m)
