"""Exact duplicates against plain Python, whatever the partitions and the ways of the merge."""

import hashlib
import re

import pytest

from kbspark.llm import exact_dedup


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        at = ids.index(keep)
        out += [(i, keep, len(ids), n == at, hashlib.sha256(body.encode()).hexdigest()) for n, i in enumerate(ids)]
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[3], r[4])


@pytest.mark.parametrize("ways", [2, 8])
@pytest.mark.parametrize("parts", [1, 3, 21])
def test_exact_duplicates(spark, ways, parts):
    texts = ["a b", "a  b", "a\t\nb", " a b", "a b ", None, "", " ", "\x0b\x0c", "\x1f", " ", "ß" * 5000, "ß" * 5001, "A b"]
    rows = [(i * 7 % 300, texts[i % len(texts)]) for i in range(300)] + [(i, "hot text") for i in range(1000, 1200)] + [(None, "no id"), (None, "no  id"), (None, "a b"), (5, "a b"), (5, "a b"), (1100, "hot text")]
    df = spark.createDataFrame([(i, t, "x", 1, 2, "s") for i, t in rows], "doc_id long, text string, digest string, run int, place int, sha string").repartition(parts)
    got = [tuple(r) for r in exact_dedup.exact_duplicates(df, ways=ways).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_empty_table_and_other_keys(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect()} == {("a", "a", True), ("b", "a", False), ("c", "c", True)}
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(df, ways=3)


def test_no_python_in_the_plan(spark, documents):
    plan = exact_dedup.exact_duplicates(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
