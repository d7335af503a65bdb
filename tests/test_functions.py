"""Worked examples of the text and matching functions, and a stream against its batch form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import integrity as M
from kbspark.operators import matching as K
from kbspark.operators.indexing import chunks_of, page_text
from kbspark.sources import tables as S
from kbspark.streaming import events as W


def value(spark, column, **fields):
    return spark.createDataFrame([tuple(fields.values())], list(fields)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("asked", "want"), [("What's UP, dont\\'t?", "what is up do not't"), ("I  can't\tgo!", "i cannot go"), ("", "")])
def test_normalize(spark, asked, want):
    assert value(spark, T.normalize_question(F.col("q")), q=asked) == want


@pytest.mark.parametrize(
    ("word", "term", "want"),
    [("parking", "park", True), ("parkinson", "park", False), ("park", "parking", True), ("registration", "register", False), ("registered", "register", True), ("admissions", "admission*", True), ("question", "*tion", True),
     ("logistics", "*gist*", True), ("rexer", "re*er", True), ("any", "*", True), ("forgiveness", "for", False)],
)
def test_term_matches(spark, word, term, want):
    assert value(spark, K.term_matches(F.col("w"), F.col("t")), w=word, t=term) is want


def test_pattern(spark):
    words = F.split("w", " ")
    assert value(spark, K.pattern_score(K.parsed(F.col("p")), words), w="a1 b1", p="a1&b1") == 45
    assert value(spark, K.pattern_score(K.parsed(F.col("p")), words), w="a1", p="a1|zz&a1") == 10
    assert value(spark, K.pattern_matches(K.parsed(F.col("p")), words, F.col("q")), w="aid", q="need Financial  aid now", p="financial+aid") is True
    assert value(spark, K.pattern_matches(K.parsed(F.col("p")), words, F.col("q")), w="aid", q="aid financial", p="financial+aid") is False


def test_match_default_and_reuse(spark):
    kb = spark.createDataFrame([(1, "transfer", "aadefault", 0, "q", "r"), (2, "transfer", "credit*", 0, "q", "r"), (3, "tour", "", 0, "q", "r")], "id long, keyword string, sub_keyword string, hits int, question string, response string")
    asked = spark.createDataFrame([(1, "How do transfers work"), (2, "Do transfer credits count"), (3, "zzz qqq"), (4, None)], "id long, question string")
    got = {r["id"]: (r["entry_id"], r["score"]) for r in K.find_matches(asked, kb, min_score=60).where("place = 1").collect()}
    assert got == {1: (1, 100), 2: (2, 110)}


def test_chunks_and_pages():
    assert chunks_of("a b c") == []
    parts = chunks_of("\n\n".join(" ".join(f"w{i}x{j}" for j in range(100)) for i in range(8)))
    assert len(parts) > 1 and parts[1].split()[:40] == parts[0].split()[-40:]
    assert page_text("<nav>no</nav><main><p>one<br>two</p><script>x</script></main><footer>no</footer>") == "one\ntwo"


def test_accepted(spark):
    t = dt.datetime(2024, 1, 1)
    hits = [(1, t + dt.timedelta(seconds=i * 0.9)) for i in range(61)] + [(1, t + dt.timedelta(seconds=54 + 61))]
    got = [r["accepted"] for r in M.accepted(spark.createDataFrame(hits, "ip long, ts timestamp"), ["ip"], 60, 60).orderBy("ts").collect()]
    assert got == [True] * 60 + [False, True]


def test_clean_pattern(spark):
    assert value(spark, M.clean_pattern(F.col("p"), F.lit("class"), ["how"]), p="how&drop*&class|ab|*|social+security") == "drop*|social&security"


def test_csv_import(spark, tmp_path):
    p = tmp_path / "k.csv"
    p.write_text('Keyword, Response,status\nfees,"a, b",odd\n\nbad row\ntour,ok,hold\n')
    good, bad = S.import_csv_validated(spark, str(p), ["keyword", "response"])
    assert sorted((r["keyword"], r["response"], r["status"]) for r in good.collect()) == [("fees", "a, b", "active"), ("tour", "ok", "hold")]
    assert bad.count() == 1
    with pytest.raises(ValueError):
        S.import_csv_validated(spark, str(p), ["other"])


def test_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, t + dt.timedelta(minutes=7 * i), None if i % 3 else "exact") for i in range(200)], "id long, created_at timestamp, match_type string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    W.run_available(W.question_counts(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in W.question_counts(rows).collect()}
    assert got and got <= want and len(want) - len(got) <= 2  # the last windows wait for the watermark
