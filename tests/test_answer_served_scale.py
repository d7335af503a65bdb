"""answer_served(): many questions and answers of the same seconds."""

import time

from kbspark.operators import joins as J


def test_busy_seconds(spark):
    rows = spark.range(60000).selectExpr("id", "timestamp_seconds(1700000000 + id % 20) as created_at", "cast(null as long) as logged_question_id")
    began = time.time()
    got = J.answer_served(rows.select("id", "created_at"), rows.selectExpr("id + 7 as id", "logged_question_id", "created_at"))
    # the answer of the lowest id of a question's own second, of which the first seven ids are taken by none
    assert got.where("answer_id = 7 + id % 20").count() == 60000
    assert time.time() - began < 40  # 3.6 billion pairs of one span
