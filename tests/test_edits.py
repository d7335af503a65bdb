"""The index of edits against all pairs, and how many pairs it compares."""

import random

from pyspark.sql import functions as F

from kbspark.operators import edits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def changed(rnd, word, n):
    for _ in range(n):
        i = rnd.randrange(len(word) + 1)
        word = rnd.choice([word[:i] + rnd.choice("abc") + word[i:], word[:i] + word[i + 1 :], word[:i] + rnd.choice("abc") + word[i + 1 :]])
    return word


def of(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_same_as_all_pairs(spark):
    rnd = random.Random(2)
    words = {"".join(rnd.choices("abc", k=rnd.randrange(1, 34))) for _ in range(150)} | {"é", "éa", "a" * 21, "a" * 19}
    tokens = {changed(rnd, w, rnd.randrange(0, 6)) for w in words} | {"", "x", "a" * 22}
    bounds = [
        (lambda t, w: F.when(t >= 6, 2).otherwise(1), lambda t, w: 2 if t >= 6 else 1),
        (lambda t, w: F.floor(F.greatest(t, w) * 0.25 + 1e-9).cast("int"), lambda t, w: int(max(t, w) * 0.25 + 1e-9)),
        (lambda t, w: F.floor(F.greatest(t, w) * 0.4 + 1e-9).cast("int"), lambda t, w: int(max(t, w) * 0.4 + 1e-9)),
    ]
    for bound, plain in bounds:
        got = [(r["token"], r["word"], r["distance"]) for r in edits.near(of(spark, "token", [*tokens, None]), of(spark, "word", [*words, None]), bound).collect()]
        want = {(t, w, distance(t, w)) for t in tokens for w in words if t and abs(len(t) - len(w)) <= 2 and distance(t, w) <= plain(len(t), len(w))}
        assert len(got) == len(set(got)) and set(got) == want


def test_few_pairs_are_compared(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("etaoinshrdlucmfw", k=rnd.randrange(5, 12))) for _ in range(100_000)]
    tokens = [changed(rnd, w, 1 + (len(w) > 6)) for w in words[::500]]
    bound = lambda t, w: F.when(t >= 6, 2).otherwise(1)
    met = edits.meetings(of(spark, "token", tokens), of(spark, "word", words), bound).distinct().count()
    found = edits.near(of(spark, "token", tokens), of(spark, "word", words), bound).count()
    assert found >= 0.9 * len(tokens) and met < 20 * found < len(tokens) * len(words) / 100
