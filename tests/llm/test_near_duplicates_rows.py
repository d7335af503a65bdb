"""The pipeline keeps one row of a group of near copies also where doc_id is null or repeated."""

import random

import corpus_pipeline
from kbspark.llm import simhash
from tests.llm.test_simhash import plain_components


def test_null_and_repeated_keys(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(3, 9)))
    a, b, c, d = (" ".join(word() for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, a), (None, a.upper()), (None, b), (1, b), (None, b + "!"), (2, c), (2, d), (3, d), (1, d.upper()), (5, None)]
    groups = plain_components([simhash.fingerprint_of(t) for _, t in rows])
    assert len(set(groups)) == 5
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    got = [(r["doc_id"], r["text"]) for r in kept]
    assert len(got) == 5 and set(got) >= {(1, b), (2, c), (1, d.upper()), (5, None)}
    assert sum(i is None for i, _ in got) == 1
