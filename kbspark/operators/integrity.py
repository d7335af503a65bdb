"""Checks and repairs between stores; patterns from example phrasings; state folds."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.sources.tables import written


def pattern_tokens(pattern: Column) -> Column:
    """The different words of a pattern, wildcards dropped."""
    parts = F.split(F.lower(F.coalesce(pattern, F.lit(""))), r"[|&+\s]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.replace(p, F.lit("*"), F.lit(""))), lambda p: p != ""))


def reuse_repair(orphans: DataFrame, entries: DataFrame, least: float = 0.6, lead: float = 0.2) -> DataFrame:
    """For orphans(id, keyword, pattern): the best entry of the keyword by token overlap; auto if clearly ahead.

    Not orphans and entries meet but their different sets of tokens, and of these only those that share one; without any the
    keyword's first entry is the best, at 0. A set stands for its entries with the lowest id, twice if it has more than one, and the
    two best of an orphans' set decide for all of its orphans."""
    a = orphans.select(F.col("id").alias("orphan_id"), F.lower("keyword").alias("k"), F.sort_array(pattern_tokens(F.col("pattern"))).alias("a"))
    b = entries.select("id", F.lower("keyword").alias("k"), F.sort_array(pattern_tokens(F.col("sub_keyword"))).alias("b")).where("k is not null")
    b = written(b.groupBy("k", "b").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    sets = a.select("k", "a").where("k is not null").distinct()
    shared = sets.select("k", "a", F.explode("a").alias("t")).join(b.select("k", "b", "id", "n", F.explode("b").alias("t")), ["k", "t"]).groupBy("k", "a", "b", "id", "n").agg(F.count("*").alias("both"))
    similarity = F.round(F.col("both") / (F.size("a") + F.size("b") - F.col("both")), 2)
    pairs = shared.select("k", "a", similarity.alias("similarity"), F.explode(F.array_repeat("id", F.least("n", F.lit(2)).cast("int"))).alias("id"))
    none = sets.join(b.groupBy("k").agg(F.min("id").alias("id")), "k").select("k", "a", F.lit(0.0).alias("similarity"), "id")
    order = [F.desc("similarity"), "id"]
    two = pairs.union(none).withColumn("_n", F.row_number().over(Window.partitionBy("k", "a").orderBy(*order))).where("_n <= 2").drop("_n")
    w = Window.partitionBy("orphan_id").orderBy(*order)
    best = a.join(two, ["k", "a"]).withColumns({"_n": F.row_number().over(w), "second": F.coalesce(F.lead("similarity").over(w), F.lit(0.0))}).where("_n = 1")
    return best.select("orphan_id", F.col("id").alias("target_id"), "similarity", ((F.col("similarity") >= least) & (F.round(F.col("similarity") - F.col("second"), 2) >= lead)).alias("auto"))


def stranded(vectors: DataFrame, active: DataFrame, content_type: str) -> DataFrame:
    """Current vector rows of a type whose content is gone; active(content_id)."""
    return vectors.where((F.col("content_type") == content_type) & F.col("is_current")).join(active, "content_id", "left_anti")


def missing(active: DataFrame, vectors: DataFrame, content_type: str) -> DataFrame:
    """Content without a current vector row."""
    return active.join(vectors.where((F.col("content_type") == content_type) & F.col("is_current")).select("content_id"), "content_id", "left_anti")


def guarded(rows: DataFrame, most: int, forced: bool = False) -> DataFrame:
    """rows, unless there are more than `most` and it is not forced: such a change is refused as a whole."""
    if not forced and rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; pass forced=True to go on")
    return rows


def embedding_status(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("content_type").agg(F.count("*").alias("total"), F.count(F.when(F.col("is_current"), 1)).alias("current"))


def embedding_report(vectors: DataFrame, entries: DataFrame, chunks: DataFrame, queue: DataFrame) -> DataFrame:
    """(name, n): open and failed rows of the queue(status), active entries(content_id) and chunks(content_id) in all, how many of
    them have a current vector, and stranded_rows: current vectors, repeats apart, whose content is gone."""
    live = entries.select(F.lit("kb_entry").alias("content_type"), "content_id").union(chunks.select(F.lit("chunk"), "content_id")).distinct()
    current = vectors.where(F.col("is_current") & F.col("content_type").isin("kb_entry", "chunk")).select("content_type", "content_id").distinct()
    both = live.withColumn("_live", F.lit(True)).join(current.withColumn("_has", F.lit(True)), ["content_type", "content_id"], "full")
    one = F.col("content_type") == "kb_entry"
    found = F.col("_live") & F.col("_has")
    counts = {"total_kb_entries": one & F.col("_live"), "total_chunks": ~one & F.col("_live"), "embedded_kb_entries": one & found, "embedded_chunks": ~one & found, "stranded_rows": F.col("_live").isNull()}
    waiting = {x: F.col("status") == x for x in ("pending", "processing", "failed")}

    def named(rows: DataFrame, kinds: dict) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(k).alias("name"), F.count_if(c).alias("n")) for k, c in kinds.items()))
        return rows.agg(pairs.alias("l")).select(F.inline("l"))

    return named(queue, waiting).union(named(both, counts))


def vector_upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both with the incoming one where both have a key; repeated incoming keys: the highest version."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc("version")))).where("_n = 1").drop("_n", "_new")


def mark_stale(vectors: DataFrame, sources: DataFrame) -> DataFrame:
    """is_current set to false for rows of the given sources(source_id)."""
    flagged = vectors.join(sources.select("source_id").distinct().withColumn("_gone", F.lit(True)), "source_id", "left")
    return flagged.withColumn("is_current", F.col("is_current") & F.col("_gone").isNull()).drop("_gone")


def _legacy_rows(legacy: DataFrame) -> DataFrame:
    """One row for each keyword and pattern of legacy(id, keyword, subkeyword, rq, reuse, rkey, rsubkey): the last written."""
    rest = F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in ("rq", "reuse", "rkey", "rsubkey")))
    last = legacy.groupBy(F.col("keyword").alias("_k"), F.coalesce("subkeyword", F.lit("")).alias("_s")).agg(F.max_by(rest, "id").alias("old"))
    points = (F.col("old.reuse") == "yes") & (F.col("old.rkey") != "")
    return last.withColumn("points", points)


def _with_legacy(knowledge: DataFrame, legacy: DataFrame) -> DataFrame:
    """Entries with `sub` (their pattern as it is compared), `pointed` (they have a reuse pointer), and `old` and `points` of their legacy row."""
    rows = knowledge.withColumns({"_k": F.col("keyword"), "_s": F.coalesce("sub_keyword", F.lit("")), "sub": F.lower(F.trim(F.coalesce("sub_keyword", F.lit("")))), "pointed": F.coalesce("reuse_response", F.lit(0)) != 0})
    return rows.join(_legacy_rows(legacy), ["_k", "_s"], "left")


def _target() -> dict[str, Column]:
    """Where a restored pointer leads: the legacy row's keyword, and its pattern or, without one, the keyword's default."""
    return {"reuse_keyword": F.col("old.rkey"), "reuse_sub_keyword": F.when(F.col("old.rsubkey") != "", F.col("old.rsubkey")).otherwise("aadefault")}


def migration_buckets(knowledge: DataFrame, legacy: DataFrame, variations: DataFrame | None = None) -> DataFrame:
    """(id, bucket, variations, matched, listed, pointer, reuse_keyword, reuse_sub_keyword): what legacy rows give each entry.

    knowledge(id, keyword, sub_keyword, question, reuse_response); legacy(id, keyword, subkeyword, rq, reuse, rkey, rsubkey), met
    by keyword and pattern, of equal ones the highest id; rq holds `|`-separated phrasings, of which those of three characters or
    more count once. Without any, the question is the one phrasing, if it has three characters. variations(knowledge_id): entries
    that have phrasings already are `already_migrated`. pointer: `set` or `missing` where the legacy row reuses another response,
    else null; entries without a pattern, or with the default one, are left alone. listed: the legacy row has phrasings."""
    rows = _with_legacy(knowledge, legacy)
    has = F.lit(False)
    if variations is not None:
        known = variations.select(F.col("knowledge_id").alias("id")).distinct().withColumn("_has", F.lit(True))
        rows, has = rows.join(known, "id", "left"), F.coalesce("_has", F.lit(False))
    matched = F.col("old").isNotNull()
    parts = F.array_distinct(F.filter(F.transform(F.split("old.rq", r"\|"), lambda x: F.trim(x)), lambda x: F.length(x) >= 3))
    question = F.trim(F.coalesce("question", F.lit("")))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"_parts": F.when(matched, parts).otherwise(none), "_own": F.when(F.length(question) >= 3, F.array(question)).otherwise(none)})
    n, skipped = F.size("_parts"), F.col("sub").isin("aadefault", "")
    bucket = (
        F.when(skipped, "aadefault").when(has, "already_migrated").when(n >= 2, "matched_multi").when(n == 1, "matched_single")
        .when(F.size("_own") == 0, "no_question").when(matched, "matched_no_var").otherwise("unmatched")
    )
    points = ~skipped & F.coalesce("points", F.lit(False))
    pointer = F.when(points & F.col("pointed"), "set").when(points, "missing")
    target = {c: F.when(points, v) for c, v in _target().items()}
    found = F.when(skipped, none).when(n > 0, F.col("_parts")).otherwise(F.col("_own"))
    return rows.select("id", bucket.alias("bucket"), found.alias("variations"), matched.alias("matched"), (matched & (F.col("old.rq") != "")).alias("listed"), pointer.alias("pointer"), *(v.alias(c) for c, v in target.items()))


def apply_migration(buckets: DataFrame) -> DataFrame:
    """(knowledge_id, variation_text, sort_order) to append: phrasings of entries that have none yet."""
    rows = buckets.where("bucket not in ('aadefault', 'already_migrated', 'no_question')").select(F.col("id").alias("knowledge_id"), F.posexplode("variations").alias("sort_order", "variation_text"))
    return rows.withColumn("variation_text", F.substring("variation_text", 1, 500))


def missing_pointers(buckets: DataFrame) -> DataFrame:
    """(id, reuse_response, reuse_keyword, reuse_sub_keyword) to set, of entries with phrasings of their own too."""
    return buckets.where("pointer = 'missing'").select("id", F.lit(1).alias("reuse_response"), "reuse_keyword", "reuse_sub_keyword")


def migration_stats(buckets: DataFrame) -> DataFrame:
    """One row: what apply_migration() and missing_pointers() do. already_migrated: entries that neither changes."""
    free = ~F.col("bucket").isin("aadefault", "already_migrated")
    some = F.size("variations") > 0
    adds, sets = free & some, F.coalesce(F.col("pointer") == "missing", F.lit(False))
    kinds = {
        "total_rows": F.lit(True), "aadefault_skipped": F.col("bucket") == "aadefault", "already_migrated": (F.col("bucket") != "aadefault") & ~adds & ~sets, "matched_with_variations": free & F.col("listed") & some,
        "matched_no_variations": free & F.col("matched") & ~(F.col("listed") & some), "unmatched_fallback": free & ~F.col("matched"), "reuse_pointers_restored": sets,
    }
    inserted = F.coalesce(F.sum(F.when(adds, F.size("variations"))), F.lit(0)).cast("long")
    return buckets.agg(*(F.count_if(c).alias(k) for k, c in kinds.items()), inserted.alias("variations_inserted"))


def restore_reuse_pointers(knowledge: DataFrame, legacy: DataFrame) -> DataFrame:
    """(id, outcome, reuse_keyword, reuse_sub_keyword) of entries with a pattern of their own, arguments as for migration_buckets().

    outcome: `already_set`, `no_match` (no legacy row), `says_no` (that one reuses nothing) or `restored`, with where it leads now."""
    rows = _with_legacy(knowledge, legacy).where(~F.col("sub").isin("aadefault", ""))
    outcome = F.when(F.col("pointed"), "already_set").when(F.col("old").isNull(), "no_match").when(F.col("points"), "restored").otherwise("says_no")
    return rows.withColumn("outcome", outcome).select("id", "outcome", *(F.when(F.col("outcome") == "restored", v).alias(c) for c, v in _target().items()))


def replace_variations(variations: DataFrame) -> DataFrame:
    """Texts trimmed and cut to 500, empty ones dropped, numbered anew for each entry."""
    rows = variations.withColumn("variation_text", F.substring(F.trim("variation_text"), 1, 500)).where("variation_text <> ''")
    return rows.withColumn("sort_order", F.row_number().over(Window.partitionBy("knowledge_id").orderBy("sort_order", "variation_text")) - 1)


def synonym_conflicts(synonyms: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(canonical_word, variant): variants and misspellings that are keywords of their own."""
    lists = F.array_union(F.split(F.coalesce("variant_words", F.lit("")), ","), F.split(F.coalesce("misspellings", F.lit("")), ","))
    rows = synonyms.select(F.lower("canonical_word").alias("canonical_word"), F.explode(lists).alias("v")).select("canonical_word", F.lower(F.trim("v")).alias("variant"))
    keywords = knowledge.select(F.lower("keyword").alias("variant")).distinct()
    return rows.where("variant <> '' and variant <> canonical_word").distinct().join(keywords, "variant", "left_semi")


def clean_pattern(pattern: Column, keyword: Column, generic: list[str]) -> Column:
    """A pattern without short parts, the keyword itself, generic words and bare wildcards; `+` becomes `&`."""
    def group(g):
        parts = F.transform(F.split(g, r"[&+]"), lambda p: F.trim(p))
        return F.array_join(F.filter(parts, lambda p: (F.length(p) >= 3) & (F.lower(p) != F.lower(keyword)) & ~F.lower(F.replace(p, F.lit("*"), F.lit(""))).isin(generic) & (F.replace(p, F.lit("*"), F.lit("")) != "")), "&")

    return F.array_join(F.filter(F.transform(F.split(pattern, r"\|"), group), lambda g: g != ""), "|")


def primary_keyword(variations: DataFrame, stopwords: list[str]) -> DataFrame:
    """(knowledge_id, word, n): the word in most variations of an entry; ties: the first seen."""
    words = variations.select("knowledge_id", "sort_order", F.posexplode(F.array_distinct(F.split(F.lower("variation_text"), r"\W+"))).alias("at", "word"))
    words = words.where((F.length("word") >= 3) & ~F.col("word").isin(stopwords))
    counts = words.groupBy("knowledge_id", "word").agg(F.count("*").alias("n"), F.min(F.struct("sort_order", "at")).alias("first"))
    best = counts.withColumn("_n", F.row_number().over(Window.partitionBy("knowledge_id").orderBy(F.desc("n"), "first", "word"))).where("_n = 1")
    return best.select("knowledge_id", "word", "n")


def bulk_run_summary(results: DataFrame) -> DataFrame:
    """Per run: how many results are done, failed or open, what they cost, and the run's state."""
    out = results.groupBy("run_id").agg(F.count("*").alias("total"), F.count(F.when(F.col("status") == "done", 1)).alias("done"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"), F.sum("cost").alias("cost"))
    open_ = F.col("total") - F.col("done") - F.col("failed")
    return out.withColumns({"remaining": open_, "state": F.when(open_ == 0, "complete").otherwise("running")})


def promote(answers: DataFrame, decided: DataFrame) -> DataFrame:
    """Answers with the status decided for their question; decided(question, status); only pending ones change."""
    key = F.lower(F.trim("question"))
    new = decided.groupBy(key.alias("_q")).agg(F.max("status").alias("_status"))
    out = answers.withColumn("_q", key).join(new, "_q", "left")
    return out.withColumn("status", F.when((F.col("status") == "pending") & F.col("_status").isNotNull(), F.col("_status")).otherwise(F.col("status"))).drop("_q", "_status")


def accepted(events: DataFrame, key: list[str], seconds: int, most: int) -> DataFrame:
    """events(…, ts) with `accepted`: at most `most` of a key within a life of `seconds` that every accepted event renews.

    An ordered fold for each key: whether an event counts depends on which before it did. A key's events come to
    one task, sorted, and pass through it in batches: a counter and a time are all that is held of them."""
    schema = events.withColumn("accepted", F.lit(True)).schema

    def fold(batches):
        own, count, last = None, 0, None
        for batch in batches:
            out = []
            for *k, ts in zip(*(batch.column(c).to_pylist() for c in [*key, "ts"])):
                if k != own:
                    own, count, last = k, 0, None
                elif ts is not None and last is not None and (ts - last).total_seconds() >= seconds:
                    count = 0
                ok = count < most
                if ok:
                    count, last = count + 1, ts
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "accepted"])

    rest = [c for c in events.columns if c not in (*key, "ts")]  # events of one time in the order of what else they have
    return events.repartition(*key).sortWithinPartitions(*key, F.col("ts").asc_nulls_last(), *rest).mapInArrow(fold, schema)


def throttled(events: DataFrame, key: list[str], seconds: int = 3600, most: int = 5) -> DataFrame:
    """events(…, ts, spam) with `outcome`: spam, throttled where `most` of the key were stored within `seconds` before, else stored.

    An ordered fold as accepted() is; the times of the last `most` that were stored are all that is held of a key."""
    schema = events.withColumn("outcome", F.lit("")).schema

    def fold(batches):
        own, stored = None, deque(maxlen=most)
        for batch in batches:
            out = []
            for *k, ts, spam in zip(*(batch.column(c).to_pylist() for c in [*key, "ts", "spam"])):
                if k != own:
                    own = k
                    stored.clear()
                if spam:
                    out.append("spam")
                elif ts is None or len(stored) == most and (ts - stored[0]).total_seconds() < seconds:
                    out.append("throttled")
                else:
                    stored.append(ts)
                    out.append("stored")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "outcome"])

    rest = [c for c in events.columns if c not in (*key, "ts")]
    return events.repartition(*key).sortWithinPartitions(*key, F.col("ts").asc_nulls_last(), *rest).mapInArrow(fold, schema)


def queue_fold(events: DataFrame, retries: int = 3) -> DataFrame:
    """(content_id, status, retry_count) from enqueue, success, failure and retry events in the order of time.

    Only what follows a key's last reset counts, so a window finds that and an aggregation the rest."""
    w = Window.partitionBy("content_id")
    rows = events.withColumn("_reset", F.max(F.when(F.col("kind").isin("enqueue", "retry", "success"), F.struct("ts", "event_id"))).over(w))
    last = F.struct("ts", "event_id")
    out = rows.groupBy("content_id").agg(
        F.max_by("kind", F.when(last == F.col("_reset"), last)).alias("reset"), F.count(F.when((F.col("kind") == "failure") & (F.col("_reset").isNull() | (last > F.col("_reset"))), 1)).alias("fails")
    )
    status = F.when((F.col("reset") == "success") & (F.col("fails") == 0), "done").when(F.col("fails") >= retries, "failed").otherwise("pending")
    return out.select("content_id", status.alias("status"), F.least("fails", F.lit(retries)).cast("int").alias("retry_count"))


def request_metrics(spans: DataFrame) -> DataFrame:
    """One row for each request from its stage spans; render is what the other stages leave of the total."""
    stages = ("total", "kb", "retrieval", "synthesis", "render")
    out = spans.where("question_id is not null").groupBy("request_id", "question_id").agg(*(F.max(F.when(F.col("stage") == s, F.col("ms"))).alias(f"{s}_ms") for s in stages))
    left = F.col("total_ms") - sum((F.coalesce(f"{s}_ms", F.lit(0)) for s in stages[1:4]), F.lit(0))
    return out.withColumn("render_ms", F.coalesce("render_ms", F.greatest(F.lit(0), left)))
