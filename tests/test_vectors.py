"""Vector search against plain numpy, with ties, repeated rows and one list that holds most of the rows."""

import numpy as np
import pytest

from kbspark.operators import vectors as V


def made(n, dims=16, seed=3, centres=8):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(centres, dims))
    return middle[rnd.integers(0, centres, n)] + 0.6 * rnd.normal(size=(n, dims))


def plain(m, q, k):
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.round(unit(q) @ unit(m).T, 9)
    return {i: [int(j) for j in np.lexsort((np.arange(len(m)), -row))[:k]] for i, row in enumerate(s)}


def frame(spark, m, key):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{key} long, embedding array<double>")


def lists_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["chunk_id"])
    return out


@pytest.mark.parametrize("block, chunk", [(2048, 16384), (7, 100)])
def test_exact(spark, block, chunk):
    m, q = made(700), made(25, seed=4)
    m[100:400] = m[5]  # ties of 300 rows
    m[500] = 0
    q[3] = m[5]
    assert lists_of(V.vector_topk(frame(spark, m, "chunk_id"), frame(spark, q, "query_id"), 10, block, chunk)) == plain(m, q, 10)


def test_steps_change_nothing(monkeypatch):
    m, q = made(500), made(9, seed=5)
    m[50:90] = m[7]
    whole = [x.tolist() for x in V.nearest(q, np.arange(9), m, np.arange(500), 12)]
    for step in (1, 13, 499):
        monkeypatch.setattr(V, "STEP", step)
        assert [x.tolist() for x in V.nearest(q, np.arange(9), m, np.arange(500), 12)] == whole


def test_inverted_lists(spark):
    m, q = made(3000, centres=20), made(60, seed=4, centres=20)
    m[:1500] = m[0] + 0.01 * made(1500, seed=8)  # half of the rows in one list
    stored, asked = frame(spark, m, "chunk_id"), frame(spark, q, "query_id")
    want = plain(m, q, 20)
    centres = V.learn_lists(stored, 32)
    assert lists_of(V.vector_ann(stored, asked, 20, 32, 32, centres, block=16, chunk=200)) == want
    found = lists_of(V.vector_ann(stored, asked, 20, 32, 12, centres))
    recall = np.mean([len(set(found[i]) & set(want[i])) / 20 for i in want])
    assert recall >= 0.9


def test_empty(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    assert V.vector_topk(none, frame(spark, made(3), "query_id")).collect() == []
