"""Scores against a plain computation over every window, misspellings, and rows of every kind."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import toxicity


def plain_odds(model, text):
    """(highest window, whole text), from the bags of every word."""
    words = [w for raw in (text or "").lower().split() if (w := raw.strip(toxicity._EDGES))]
    bags = [toxicity.buckets_of(w, len(model.weights) - 1) for w in words]
    if not bags:
        return None
    value = lambda part: sum(model.weights[b] for bag in part for b in bag) / max(sum(map(len, part)), toxicity.LEAST_GRAMS) + model.bias
    n = toxicity.SEGMENT
    return max(value(bags[i : i + n]) for i in range(max(1, len(bags) - n + 1))), value(bags)


def test_every_window_and_the_average(spark):
    rnd = random.Random(3)
    model = toxicity.Model(np.random.default_rng(1).normal(0, 2, 1 << 10), -0.5)
    texts = [" ".join("".join(rnd.choice("abcdef,.") for _ in range(rnd.randrange(1, 7))) for _ in range(rnd.randrange(0, 70))) for _ in range(200)] + [None, "", "... !!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit(5.0)).withColumn("_scored_", F.lit(1))
    got = {r["doc_id"]: r for r in toxicity.score(df, model, average="mean").collect()}
    for i, text in enumerate(texts):
        odds = plain_odds(model, text)
        want = (0.0, 0.0) if odds is None else tuple(1 / (1 + math.exp(-x)) for x in odds)
        assert (got[i]["score"], got[i]["mean"]) == (pytest.approx(want[0], abs=1e-9), pytest.approx(want[1], abs=1e-9))
    assert toxicity.score(df.limit(0), model).count() == 0


def test_place_and_spelling_do_not_hide_a_word():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 8)))
    texts, labels = [], []
    for i in range(400):
        body = [word() for _ in range(rnd.randrange(5, 100))]
        if i % 4 == 0:
            body[rnd.randrange(len(body))] = rnd.choice(["zgrumpf", "bazwurk"])
        texts.append(" ".join(body))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, labels)
    for miss in ("zgrumpfs", "zzgrumpf", "bazwurks", "bazwurkk"):
        for before in range(0, 40, 3):
            assert model.score(" ".join([word() for _ in range(before)] + [miss] + [word() for _ in range(20)])) >= 0.7
    clean = [model.score(" ".join(word() for _ in range(60))) >= 0.7 for _ in range(100)]
    assert np.mean(clean) < 0.1
