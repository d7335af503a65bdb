"""Streams over the question log; every function takes a streaming or a static frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.operators.analytics import _count, matched


def question_counts(questions: DataFrame, span: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Totals, matched and unmatched for each window; rows later than the watermark are dropped in a stream."""
    rows = questions.withWatermark("created_at", late)
    window = F.window("created_at", span, slide) if slide else F.window("created_at", span)
    out = rows.groupBy(window.alias("w")).agg(F.count("*").alias("total"), _count(matched()).alias("matched"), _count(~matched()).alias("unmatched"))
    return out.select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "total", "matched", "unmatched")


def match_rate_sliding(questions: DataFrame) -> DataFrame:
    out = question_counts(questions, "7 days", "1 day", "1 day")
    return out.withColumn("match_rate", F.round(100.0 * F.col("matched") / F.col("total"), 1))


def visitor_sessions(questions: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(ip_address, start_at, turns): a visitor's questions without a longer gap."""
    rows = questions.withWatermark("created_at", gap)
    out = rows.groupBy("ip_address", F.session_window("created_at", gap).alias("w")).agg(F.count("*").alias("turns"))
    return out.select("ip_address", F.col("w.start").alias("start_at"), "turns")


def late_rejections(questions: DataFrame, rejections: DataFrame, within: str = "1 hour") -> DataFrame:
    """Questions with ai_rejected set where a rejection(question_id, rejected_at) follows within the time."""
    q = questions.withWatermark("created_at", within)
    r = rejections.withWatermark("rejected_at", within)
    on = (q["id"] == r["question_id"]) & (r["rejected_at"] >= q["created_at"]) & (r["rejected_at"] <= q["created_at"] + F.expr(f"interval {within}"))
    return q.join(r, on, "left").select("id", "created_at", F.col("question_id").isNotNull().cast("int").alias("ai_rejected"))


def visitors_upsert(visits: DataFrame, known: DataFrame) -> DataFrame:
    """known(ip_address, visit_count, first_visit, last_visit) with new visits(ip_address, created_at) added."""
    new = visits.groupBy("ip_address").agg(F.count("*").alias("visit_count"), F.min("created_at").alias("first_visit"), F.max("created_at").alias("last_visit"))
    both = known.select(*new.columns).unionByName(new)
    return both.groupBy("ip_address").agg(F.sum("visit_count").alias("visit_count"), F.min("first_visit").alias("first_visit"), F.max("last_visit").alias("last_visit"))


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what a stream's source holds now and writes it as Parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
