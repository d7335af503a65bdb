"""What k9 and the dictionary read of the log: its different questions, told apart once."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kbspark.functions import text as T
from kbspark.plans import text as plans
from kbspark.plans.fixtures import projection

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_log_is_not_gone_through_again(spark):
    plan = __spark_entry__.queries()["k9_suggest_questions"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" not in plan and "p_name" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_dictionary_counts_every_use(spark):
    words = projection(spark, FOLDER, "match_questions").select(F.explode(T.tokenize(T.normalize_question(F.col("question")))).alias("word"))
    often = {r["word"] for r in words.groupBy("word").count().where("count >= 20 and word <> ''").collect()}
    base = {w for r in projection(spark, FOLDER, "match_kb").select(F.split(F.lower("question"), "[^a-z]+").alias("w")).collect() for w in r["w"] if w}
    got = plans.dictionary(spark, FOLDER)
    assert {r["word"] for r in got.collect()} == often | base
    assert "event_id" not in got._jdf.queryExecution().optimizedPlan().toString()
