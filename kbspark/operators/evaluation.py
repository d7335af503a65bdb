"""Evaluation runs: which layer would answer, runs side by side, and whether phrasings find their own entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A match of this score or more is strong.
STRONG = 90


def bulk_route(questions: DataFrame, matches: DataFrame, chunks: DataFrame, answers: DataFrame | None = None, strong: int = STRONG) -> DataFrame:
    """(id, layer) for questions(id): kb_strong with a match of that score; else, if an answer can be made, kb_weak_with_ai with
    any match and ai_only without; else no_answer.

    matches(id, score); chunks(id): questions for which something was retrieved. answers(id, answered): where it is given,
    what is made of the chunks counts, not that there are any."""
    best = matches.groupBy("id").agg(F.max("score").alias("score"))
    able = chunks.select("id").distinct().withColumn("able", F.lit(True))
    if answers is not None:
        able = able.join(answers.groupBy("id").agg(F.bool_or("answered").alias("answered")), "id").select("id", F.col("answered").alias("able"))
    rows = questions.select("id").join(best, "id", "left").join(able, "id", "left")
    made = F.coalesce("able", F.lit(False))
    return rows.select("id", F.when(F.col("score") >= strong, "kb_strong").when(made & F.col("score").isNotNull(), "kb_weak_with_ai").when(made, "ai_only").otherwise("no_answer").alias("layer"))


def compare_runs(results: DataFrame, first: str, second: str) -> DataFrame:
    """(question, first, second, same) side by side from results(run_id, question, answer, created_at): the last answer of each run."""
    last = results.where(F.col("run_id").isin(first, second)).groupBy("question", "run_id").agg(F.max_by("answer", "created_at").alias("answer"))
    wide = last.groupBy("question").agg(*(F.max(F.when(F.col("run_id") == r, F.col("answer"))).alias(c) for r, c in ((first, "first"), (second, "second"))))
    return wide.withColumn("same", F.col("first").eqNullSafe(F.col("second")))


def roundtrip_report(variations: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, entry_id, bucket, score, top_entry, needs_review) for variations(id, entry_id) by their matches(id, entry_id, score, place).

    top: the entry alone has the best score; tied: others have it too; listed: it is among the matches; missing. top_entry: the first
    other entry of the best score. An entry needs review if one of its variations is not top."""
    best = matches.withColumn("_best", F.max("score").over(Window.partitionBy("id")))
    top = best.where("score = _best").groupBy("id").agg(F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("place", "entry_id"))), lambda x: x["entry_id"]).alias("_top"))
    listed = matches.select("id", "entry_id").distinct().withColumn("_listed", F.lit(True))
    rows = variations.select("id", "entry_id").join(top, "id", "left").join(listed, ["id", "entry_id"], "left")
    own = F.coalesce(F.array_contains("_top", F.col("entry_id")), F.lit(False))
    bucket = F.when(own & (F.size("_top") == 1), "top").when(own, "tied").when(F.col("_listed"), "listed").otherwise("missing")
    rows = rows.withColumns({"bucket": bucket, "top_entry": F.get(F.filter("_top", lambda e: e != F.col("entry_id")), F.lit(0)), "score": F.coalesce("score", F.lit(0))})
    review = F.max((F.col("bucket") != "top").cast("int")).over(Window.partitionBy("entry_id")) == 1
    return rows.select("id", "entry_id", "bucket", "score", "top_entry", review.alias("needs_review"))
