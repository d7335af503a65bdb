"""Rows repeated under a query's own id take no neighbour's place."""

import numpy as np
from pyspark.sql import functions as F

from kbspark.llm import topk


def test_repeats_of_the_query(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-500, 500, 40)]) for i in range(300)]
    rows[0] = (0, [600.0] * 40)  # its own rows score highest
    rows += [rows[0]] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).collect())
    best = sorted((-int(np.dot(rows[0][1], v)), i) for i, v in rows if i != 0)[:5]
    assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_only_repeats_of_the_query(spark):
    df = spark.createDataFrame([(0, [1.0] * 40)] * 10 + [(7, [2.0] * 40)], "vec_id long, embedding array<double>").coalesce(1)
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(7, 80)]
