"""Joins over the log, the knowledge base and answers; windows that take the place of loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent_questions_with_entry(questions: DataFrame, knowledge: DataFrame, limit: int = 20) -> DataFrame:
    """The newest questions with their entry; cut first, so few rows are joined."""
    newest = questions.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    entry = knowledge.select(F.col("id").alias("knowledge_id"), "keyword", F.col("question").alias("entry_question"))
    return newest.select("id", "question", "knowledge_id").join(entry, "knowledge_id", "left")


def answer_served(questions: DataFrame, answers: DataFrame, within: int = 30) -> DataFrame:
    """Each question with the answer that was served: the linked one, else the unlinked one nearest in time.

    answers(id, logged_question_id, created_at). Only answers within `within` seconds count, ties go to the
    lowest id. Gaps are whole seconds, so of the answers of a second that of the lowest id stands for all, and questions of a second get
    the same. Seconds fall into spans of that length, so one meets the answers of three spans at most, whatever their number."""
    linked = answers.where("logged_question_id is not null").groupBy(F.col("logged_question_id").alias("id")).agg(F.min("id").alias("linked_id"))
    q = questions.select("id", F.unix_timestamp("created_at").alias("at")).join(linked, "id", "left")
    span = lambda c: F.floor(F.col(c) / within)
    asked = questions.select(F.unix_timestamp("created_at").alias("at")).where("at is not null").distinct().select("at", F.explode(F.array(*(span("at") + d for d in (-1, 0, 1)))).alias("span"))
    free = answers.where("logged_question_id is null").groupBy(F.unix_timestamp("created_at").alias("answered")).agg(F.min("id").alias("answer_id")).withColumn("span", span("answered"))
    gap = F.abs(F.col("answered") - F.col("at"))
    near = asked.join(free, "span").withColumn("gap", gap).where(F.col("gap") <= within).groupBy("at").agg(F.min(F.struct("gap", "answer_id")).alias("m"))
    return q.join(near, "at", "left").select("id", F.coalesce("linked_id", "m.answer_id").alias("answer_id"))


def tiebreak_lookup(events: DataFrame, knowledge: DataFrame) -> DataFrame:
    """The entries that tie-break events name, in comma lists or alone."""
    named = events.select(F.explode(F.split("tied_ids", ",")).alias("x")).select(F.trim("x").try_cast("long").alias("id"))
    return knowledge.join(named.where("id is not null").distinct(), "id", "left_semi").select("id", "keyword", "sub_keyword", "question")


def slowest_requests(metrics: DataFrame, questions: DataFrame, limit: int = 20, fastest: bool = False) -> DataFrame:
    """The slowest (or fastest) requests with their question; cut before the join."""
    order = F.asc("total_ms") if fastest else F.desc("total_ms")
    cut = metrics.orderBy(order, "id").limit(limit).select("id", "question_id", "total_ms")
    return cut.join(questions.select(F.col("id").alias("question_id"), "question"), "question_id", "left")


def orphan_reuse(entries: DataFrame) -> DataFrame:
    """Active entries that reuse another's response where no active entry has that keyword and pattern."""
    key = lambda k, s: (F.lower(F.col(k)).alias("_k"), F.coalesce(F.col(s), F.lit("")).alias("_s"))
    targets = entries.where("status = 'active'").select(*key("keyword", "sub_keyword")).distinct()
    own = entries.where("status = 'active' and reuse_response = 1").select("*", *key("reuse_keyword", "reuse_sub_keyword"))
    return own.join(targets, ["_k", "_s"], "left_anti").drop("_k", "_s")


def resolve_reuse(entries: DataFrame) -> DataFrame:
    """Entries with the response they are served with: that of the entry they point at, if it has one.

    A pointer to `aadefault` also means an entry without a pattern; of several targets the lowest id counts."""
    target = entries.where("status = 'active'").withColumn("_s", F.coalesce(F.expr("nullif(sub_keyword, '')"), F.lit("aadefault")))
    target = target.groupBy(F.lower("keyword").alias("_k"), "_s").agg(F.min_by(F.struct("id", "response"), "id").alias("t"))
    own = entries.select("*", F.lower("reuse_keyword").alias("_k"), F.coalesce(F.expr("nullif(reuse_sub_keyword, '')"), F.lit("aadefault")).alias("_s"))
    out = own.join(target, ["_k", "_s"], "left")
    use = (F.col("reuse_response") == 1) & F.col("t").isNotNull() & (F.trim(F.coalesce("t.response", F.lit(""))) != "")
    return out.withColumns({"reused_from": F.when(use, F.col("t.id")), "response": F.when(use, F.col("t.response")).otherwise(F.col("response"))}).drop("_k", "_s", "t")


def orphan_rows(queue: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Queue rows whose content is gone."""
    return queue.join(rows.select(F.col("id").alias(key)), key, "left_anti")


def citations_for_answer(answer_sources: DataFrame, most: int = 3) -> DataFrame:
    """The sources to cite: the used ones by overlap, or, where none was used, the first by position."""
    w = Window.partitionBy("answer_id")
    rows = answer_sources.withColumn("_any", F.max("used_in_answer").over(w)).where("used_in_answer = 1 or _any = 0")
    place = F.row_number().over(w.orderBy(F.when(F.col("_any") == 1, -F.col("overlap_score")).otherwise(F.lit(0)), "position", "source_id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("_any")


def first_per_source(retrieved: DataFrame) -> DataFrame:
    """The first chunk of every source in retrieval order, positions numbered anew from 1."""
    first = retrieved.withColumn("_n", F.row_number().over(Window.partitionBy("answer_id", "source_id").orderBy("position", "chunk_id"))).where("_n = 1").drop("_n")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("answer_id").orderBy("position", "chunk_id", "source_id")))


def sibling_variation_counts(variations: DataFrame) -> DataFrame:
    """For every entry: how many variations other entries of its keyword have (totals less its own; no self-join)."""
    own = variations.groupBy("keyword", "knowledge_id").agg(F.count("*").alias("own"))
    return own.withColumn("siblings", F.sum("own").over(Window.partitionBy("keyword")) - F.col("own"))


def latest_turns(turns: DataFrame, role: str) -> DataFrame:
    """The latest turn of a role in every conversation."""
    return turns.where(F.col("role") == role).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def tied_top(matches: DataFrame, floor: float = 100) -> DataFrame:
    """Per question: the ids that share the top score, where it reaches the floor and at least two do."""
    rows = matches.withColumn("_r", F.rank().over(Window.partitionBy("question_id").orderBy(F.desc("score")))).where((F.col("_r") == 1) & (F.col("score") >= floor))
    return rows.groupBy("question_id").agg(F.max("score").alias("score"), F.sort_array(F.collect_set("id")).alias("tied")).where(F.size("tied") >= 2)


def top_per_group(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def run_deltas(runs: DataFrame) -> DataFrame:
    """Recall of every run against the one before."""
    return runs.withColumn("delta", F.round(F.col("recall") - F.lag("recall").over(Window.orderBy("saved_at", "run_id")), 4))


def containing(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(w, token): which of the tokens(token) hold which of the words(w) of three characters or more.

    Substrings can't be found by equality, but runs of three characters can: each word is looked up by the one of its
    runs that the fewest tokens have, and what that finds is verified. Both sides are different words, not texts."""
    runs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(...))"), 1))
    wanted = words.select("w").distinct().select("w", F.explode(runs(F.col("w"))).alias("run"))
    held = tokens.select("token").distinct().select("token", F.explode(runs(F.col("token"))).alias("run")).join(wanted.select("run").distinct(), "run", "left_semi")
    counts = held.groupBy("run").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "run", "left").groupBy("w").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    return rarest.join(held, "run").where(F.contains(F.col("token"), F.col("w"))).select("w", "token")
