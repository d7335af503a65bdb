"""Reports over the question log, the knowledge base, visitors, ratings and answers.

Every report is a few partial aggregations; rates are rounded half up and 0 where nothing was counted.
`as_of` takes the place of the clock. Lists end with a unique key in their order, so ties are settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched() -> Column:
    """A question that matched some entry."""
    return F.expr("match_type is not null and match_type <> 'none'")


def _count(condition: Column | str) -> Column:
    return F.count(F.when(F.expr(condition) if isinstance(condition, str) else condition, 1))


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def since(as_of: str, days: int, column: str = "created_at") -> Column:
    return F.col(column) >= F.expr(f"timestamp '{as_of}' - interval {days} days")


def dashboard_stats(knowledge, questions, inquiries, ratings, as_of: str) -> DataFrame:
    """One row of counters over four tables."""
    day = F.expr(f"date '{as_of[:10]}'")
    k = knowledge.agg(
        F.count("*").alias("total_entries"), _count("status = 'active'").alias("active_entries"), _count("status = 'inactive'").alias("inactive_entries"), _count("status = 'hold'").alias("hold_entries"),
        _count((F.col("expires_at") >= day) & (F.col("expires_at") <= F.date_add(day, 7))).alias("expiring_soon"),
    )
    q = questions.agg(
        F.count("*").alias("total_questions"), _count(F.to_date("created_at") == day).alias("questions_today"), _count(since(as_of, 7)).alias("questions_7d"), _count(since(as_of, 30)).alias("questions_30d"),
        _count(matched()).alias("matched"), _count(~matched()).alias("unmatched"), F.countDistinct("ip_address").alias("visitors"), F.countDistinct(F.when(since(as_of, 7), F.col("ip_address"))).alias("visitors_7d"),
    )
    i = inquiries.agg(_count("status = 'pending'").alias("pending_inquiries"), F.count("*").alias("total_inquiries"))
    r = ratings.agg(_count("rating = 'helpful'").alias("helpful"), _count("rating = 'not_helpful'").alias("not_helpful"))
    one = k.crossJoin(q).crossJoin(i).crossJoin(r)  # four frames of one row
    return one.withColumns({"match_rate": rate(F.col("matched"), F.col("total_questions")), "helpfulness_rate": rate(F.col("helpful"), F.col("helpful") + F.col("not_helpful"))})


def questions_trend(questions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per day from as_of - days to as_of: total, matched, unmatched; days without questions are 0."""
    last = F.expr(f"date '{as_of[:10]}'")
    calendar = questions.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days), last)).alias("day"))
    counts = questions.where(F.to_date("created_at").between(F.date_sub(last, days), last)).groupBy(F.to_date("created_at").alias("day"))
    counts = counts.agg(F.count("*").alias("total"), _count(matched()).alias("matched"), _count(~matched()).alias("unmatched"))
    return calendar.join(counts, "day", "left").na.fill(0)


def match_type_distribution(questions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return questions.where(since(as_of, days)).groupBy("match_type").agg(F.count("*").alias("n"))


def language_breakdown(questions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Counts by language (none or empty: en), with the share in whole percent."""
    lang = F.coalesce(F.expr("nullif(detected_language, '')"), F.lit("en"))
    counts = questions.where(since(as_of, days)).groupBy(lang.alias("language")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 0))


def top_keywords(questions: DataFrame, knowledge: DataFrame, as_of: str, days: int = 30, limit: int = 10) -> DataFrame:
    """Keywords by hits, each hit counted once for every entry of the keyword (at least once), with the best rating.

    Both sides are added up by keyword first, so the joined rows are never made."""
    asked = questions.where(since(as_of, days) & F.col("matched_keyword").isNotNull() & (F.col("matched_keyword") != "")).groupBy("matched_keyword").agg(F.count("*").alias("asked"))
    entries = knowledge.groupBy("keyword").agg(F.count("*").alias("entries"), F.max("helpful_yes").alias("yes"), F.max("helpful_no").alias("no"))
    out = asked.join(entries, asked["matched_keyword"] == entries["keyword"], "left")
    total = F.col("yes") + F.col("no")
    return out.select("matched_keyword", (F.col("asked") * F.coalesce("entries", F.lit(1))).alias("hits"), F.coalesce(rate(F.col("yes"), total, 0), F.lit(0.0)).alias("rating")).orderBy(F.desc("hits"), "matched_keyword").limit(limit)


def top_entries_by_hits(knowledge: DataFrame, as_of: str, limit: int = 10) -> DataFrame:
    day = F.expr(f"date '{as_of[:10]}'")
    live = knowledge.where((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > day)) & (F.coalesce("question", F.lit("")) != ""))
    return live.select("id", "question", "hits", rate(F.col("helpful_yes"), F.col("helpful_yes") + F.col("helpful_no")).alias("rating")).orderBy(F.desc("hits"), "id").limit(limit)


def unmatched_questions(questions: DataFrame, least: int = 1, limit: int | None = None) -> DataFrame:
    """Unmatched questions, equal ones together: count, last time, and the text of the first id."""
    key = F.lower(F.trim("question"))
    out = questions.where(~matched()).groupBy(key.alias("question_key")).agg(F.count("*").alias("n"), F.max("created_at").alias("last_asked"), F.min_by("question", "id").alias("sample_question")).where(F.col("n") >= least)
    return out.orderBy(F.desc("n"), "question_key").limit(limit) if limit else out


def visitor_geography(visitors: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Visitors and visits by country, by US region and by US city, in one pass with grouping sets."""
    active = visitors.where(since(as_of, days, "last_visit")).select("country_code", "country_name", F.when(F.col("country_code") == "US", F.col("region")).alias("region"), F.when(F.col("country_code") == "US", F.col("city")).alias("city"), "visit_count")
    sets = [[F.col("country_code"), F.col("country_name")], [F.col("country_code"), F.col("region")], [F.col("country_code"), F.col("region"), F.col("city")]]
    out = active.groupingSets(sets, "country_code", "country_name", "region", "city").agg(F.grouping_id().alias("g"), F.count("*").alias("visitors"), F.sum("visit_count").alias("visits"))
    level = F.when(F.col("g") == 3, "country").when(F.col("g") == 5, "region").otherwise("city")
    out = out.withColumn("level", level).where("level = 'country' or country_code = 'US'")
    rank = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("visitors"), F.desc("visits"), "country_code", "country_name", "region", "city"))
    return out.withColumn("place", rank).where("place <= case level when 'country' then 20 else 25 end").select("level", "country_code", "country_name", "region", "city", "visitors", "visits")


def hourly_pattern(questions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    counts = questions.where(since(as_of, days)).groupBy(F.hour("created_at").alias("h")).agg(F.count("*").alias("n"))
    hours = questions.sparkSession.range(24).select(F.col("id").cast("int").alias("h"))
    return hours.join(counts, "h", "left").select(F.format_string("%02d:00", "h").alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def weekday_pattern(questions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    names = F.array(*map(F.lit, "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()))
    counts = questions.where(since(as_of, days)).groupBy(F.dayofweek("created_at").alias("weekday")).agg(F.count("*").alias("n"))
    week = questions.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("weekday"))
    return week.join(counts, "weekday", "left").select("weekday", F.get(names, F.col("weekday") - 1).alias("name"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def period_comparison(questions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """The last days against as many before: totals, match rates, change in percent (0 without a base)."""
    now, before = since(as_of, days), since(as_of, 2 * days) & ~since(as_of, days)
    one = questions.agg(_count(now).alias("total_now"), _count(before).alias("total_before"), _count(now & matched()).alias("matched_now"), _count(before & matched()).alias("matched_before"))
    one = one.withColumns({"rate_now": rate(F.col("matched_now"), F.col("total_now")), "rate_before": rate(F.col("matched_before"), F.col("total_before"))})
    change = F.when(F.col("total_before") > 0, F.round(100.0 * (F.col("total_now") - F.col("total_before")) / F.col("total_before"), 1)).otherwise(F.lit(0.0))
    return one.withColumns({"change": change, "rate_difference": F.round(F.col("rate_now") - F.col("rate_before"), 1)})


def search_terms(questions: DataFrame, stopwords: list[str], as_of: str, days: int = 30, limit: int = 50) -> DataFrame:
    words = questions.where(since(as_of, days)).select(F.explode(F.split(F.lower("question"), r"\s+")).alias("w"))
    words = words.where((F.length("w") > 2) & ~F.col("w").isin(stopwords) & ~F.col("w").rlike(r"^[0-9.]+$")).select(F.regexp_replace("w", "[^a-z0-9]", "").alias("term")).where("term <> ''")
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(limit)


def entries_needing_attention(knowledge: DataFrame, as_of: str, limit: int = 10) -> DataFrame:
    """Four lists of at most `limit` entries: low_rated, expiring, never_accessed, high_traffic_low_rating."""
    day, total = F.expr(f"date '{as_of[:10]}'"), F.col("helpful_yes") + F.col("helpful_no")
    rows = knowledge.where("status = 'active'").withColumn("rating", rate(F.col("helpful_yes"), total))
    lists = {
        "low_rated": ((F.col("hits") >= 10) & (total > 0) & (F.col("rating") < 50), F.col("rating")),
        "expiring": ((F.col("expires_at") >= day) & (F.col("expires_at") <= F.date_add(day, 7)), F.datediff("expires_at", day).cast("double")),
        "never_accessed": (F.col("hits") == 0, F.col("id").cast("double")),
        "high_traffic_low_rating": ((F.col("hits") >= 50) & (total > 0) & (F.col("rating") < 70), -F.col("hits").cast("double")),
    }
    buckets = F.filter(F.array(*(F.when(c, F.struct(F.lit(n).alias("bucket"), o.alias("o"))) for n, (c, o) in lists.items())), lambda x: x.isNotNull())
    rows = rows.select("id", "hits", "rating", F.explode(buckets).alias("b")).select("b.bucket", "id", "hits", "rating", "b.o")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("o", "id"))).where(F.col("place") <= limit).drop("o")


def executive_summary(knowledge, questions, inquiries, ratings, as_of: str) -> DataFrame:
    """The counters with what they recommend."""
    s = dashboard_stats(knowledge, questions, inquiries, ratings, as_of)
    tips = [("match_rate < 70", "improve_match_rate"), ("pending_inquiries > 10", "answer_inquiries"), ("unmatched > 0", "add_entries"), ("expiring_soon > 0", "renew_entries"), ("helpfulness_rate < 80", "improve_answers")]
    return s.select("match_rate", "helpfulness_rate", "unmatched", F.concat_ws(",", *(F.when(F.expr(c), t) for c, t in tips)).alias("recommendations"))


def coverage_split(questions: DataFrame, answers: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Questions answered from the base, by a model, or not at all, with shares."""
    one = questions.where(since(as_of, days)).agg(F.count("*").alias("total"), _count(matched()).alias("kb"), _count(~matched()).alias("open")).crossJoin(answers.agg(F.count("*").alias("ai")))
    one = one.withColumn("none", F.greatest(F.lit(0), F.col("open") - F.col("ai")))
    return one.select("total", "kb", "ai", "none", F.round(100.0 * (F.col("kb") + F.col("ai")) / F.col("total"), 0).alias("coverage"), *(rate(F.col(c), F.col("total")).alias(f"{c}_share") for c in ("kb", "ai", "none")))


def csat(ratings: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    one = ratings.where(since(as_of, days)).agg(F.count("*").alias("total"), *(_count(F.col("rating") == r).alias(r) for r in ("helpful", "somewhat", "not_helpful")))
    return one.withColumn("helpful_rate", rate(F.col("helpful"), F.col("total")))


def source_effectiveness(usage: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per source: different answers, and ratings over all its uses; ratings are added up by conversation first."""
    rated = ratings.groupBy("conversation_id").agg(*(_count(F.col("rating") == r).alias(r) for r in ("helpful", "not_helpful")))
    used = usage.join(rated, "conversation_id", "left")
    return used.groupBy("source_id").agg(F.countDistinct("ai_answer_id").alias("answers"), F.coalesce(F.sum("helpful"), F.lit(0)).alias("helpful"), F.coalesce(F.sum("not_helpful"), F.lit(0)).alias("not_helpful"))


def answers_latest_per_question(answers: DataFrame, limit: int = 100) -> DataFrame:
    key = F.lower(F.trim("question"))
    out = answers.groupBy(key.alias("question_key")).agg(F.max("id").alias("id"), F.count("*").alias("ask_count"), F.max_by("status", "id").alias("status"))
    return out.orderBy(F.desc("id")).limit(limit)


def answer_status_counts(answers: DataFrame) -> DataFrame:
    """Different questions by status; `all` is the sum over statuses."""
    counts = answers.groupBy("status").agg(F.countDistinct(F.lower(F.trim("question"))).alias("n"))
    return counts.rollup("status").agg(F.sum("n").alias("n")).na.fill({"status": "all"})


def decision_summary(questions: DataFrame) -> DataFrame:
    one = questions.agg(F.count("*").alias("total"), _count(matched()).alias("matched"), F.coalesce(F.sum("ai_tiebreak"), F.lit(0)).alias("tiebreaks"), F.coalesce(F.sum("ai_rejected"), F.lit(0)).alias("rejections"))
    return one.withColumns({"match_rate": rate(F.col("matched"), F.col("total")), "rejection_rate": rate(F.col("rejections"), F.col("matched"))})


def decisions_by_provider(questions: DataFrame) -> DataFrame:
    rows = questions.where("(ai_tiebreak = 1 or ai_rejected = 1) and ai_provider is not null and ai_provider <> ''")
    return rows.groupBy("ai_provider").agg(F.count("*").alias("n"), F.sum("ai_tiebreak").alias("tiebreaks"), F.sum("ai_rejected").alias("rejections"))


def top_rejected_entries(questions: DataFrame, knowledge: DataFrame, limit: int = 5) -> DataFrame:
    """The entries that were rejected most; counted by id before the join."""
    counts = questions.where("ai_rejected = 1 and knowledge_id is not null").groupBy("knowledge_id").agg(F.count("*").alias("rejections"))
    out = counts.join(knowledge.select(F.col("id").alias("knowledge_id"), "keyword", "sub_keyword"), "knowledge_id", "left")
    return out.orderBy(F.desc("rejections"), "knowledge_id").limit(limit)


def keyword_overview(knowledge: DataFrame) -> DataFrame:
    return knowledge.groupBy("keyword").agg(
        F.count("*").alias("patterns"), _count("status = 'active'").alias("active"), F.max(F.when(F.col("sub_keyword") == "aadefault", F.col("question"))).alias("default_phrase"), F.sum("hits").alias("total_hits")
    )


def status_counts(knowledge: DataFrame) -> DataFrame:
    return knowledge.groupBy("status").agg(F.count("*").alias("entries"), F.countDistinct("keyword").alias("keywords"), _count(F.coalesce(F.col("sub_keyword"), F.lit("")) != "aadefault").alias("recompilable"))


def usage_monthly(usage: DataFrame) -> DataFrame:
    month = F.date_trunc("month", "created_at").cast("date").alias("month")
    return usage.groupBy("tenant_id", month).agg(
        F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_create", "cache_read")),
        _count("cache_create > 0 or cache_read > 0").alias("cache_calls"), _count("cache_read > 0").alias("cache_hits"),
    )


def token_cost(usage: DataFrame, rates: DataFrame, default_model: str) -> DataFrame:
    """Cost of each call, to a millionth, half up; the default's rates for unknown models.

    rates(model, rate_in, rate_out): money for a million tokens. Sums are in whole numbers, so they are exact."""
    scaled = lambda c: F.round(F.col(c) * 10_000, 0).cast("long").alias(c)
    known = F.broadcast(rates.select("model", scaled("rate_in"), scaled("rate_out")))  # a price list
    fallback = known.where(F.col("model") == default_model).select(F.col("rate_in").alias("_in"), F.col("rate_out").alias("_out"))
    out = usage.join(known, "model", "left").crossJoin(F.broadcast(fallback))
    i, o = F.coalesce("rate_in", "_in"), F.coalesce("rate_out", "_out")
    parts = F.col("input_tokens") * i * 100 + F.col("cache_create") * i * 125 + F.col("cache_read") * i * 10 + F.col("output_tokens") * o * 100
    micros = F.floor((parts + 500_000) / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(20,6)")
    return out.withColumn("cost", (micros / 1_000_000).cast("decimal(20,6)")).drop("rate_in", "rate_out", "_in", "_out")


def tenant_rollup(usage: DataFrame) -> DataFrame:
    """Per tenant, and a row without tenant for the network: calls, tokens and what the cache saved."""
    out = usage.rollup("tenant_id").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("cache_read").alias("cache_read"))
    return out.withColumn("saved", F.round(F.col("cache_read") / 1e6 * 3 * 0.9, 6))


def budget_status(costed: DataFrame, call_limit: int, tenant_budget: float, network_budget: float) -> DataFrame:
    """Per tenant and month: calls and cost, and whether each stays under its limit (0: no limit)."""
    month = F.date_trunc("month", "created_at").cast("date").alias("month")
    out = costed.groupBy("tenant_id", month).agg(F.count("*").alias("calls"), F.round(F.sum(F.col("cost").cast("decimal(20,6)")), 6).alias("cost"))
    network = F.sum("cost").over(Window.partitionBy("month"))
    under = lambda x, limit: F.lit(True) if limit == 0 else x < limit
    return out.withColumn("network_cost", network).withColumn("within", under(F.col("calls"), call_limit) & under(F.col("cost"), tenant_budget) & under(F.col("network_cost"), network_budget))


def rating_recount(knowledge: DataFrame, ratings: DataFrame) -> DataFrame:
    counts = ratings.groupBy("knowledge_id").agg(_count("rating = 'helpful'").alias("yes"), _count("rating = 'not_helpful'").alias("no"))
    return knowledge.select("id").join(counts, F.col("id") == F.col("knowledge_id"), "left").select("id", F.coalesce("yes", F.lit(0)).alias("helpful_yes"), F.coalesce("no", F.lit(0)).alias("helpful_no"))


def hits_recount(knowledge: DataFrame, questions: DataFrame) -> DataFrame:
    counts = questions.where("knowledge_id is not null").groupBy("knowledge_id").agg(F.count("*").alias("n"))
    return knowledge.join(counts, F.col("id") == F.col("knowledge_id"), "left").select("id", (F.col("hits") + F.coalesce("n", F.lit(0))).alias("hits"))


def approx_visitors(questions: DataFrame, error: float = 0.02) -> DataFrame:
    """Different visitors by day, from HyperLogLog sketches."""
    return questions.groupBy(F.to_date("created_at").alias("day")).agg(F.approx_count_distinct("ip_address", error).alias("visitors"))


def visitor_sketches(questions: DataFrame, bits: int = 12) -> DataFrame:
    """(day, questions, visitors): a day's questions, and a sketch of its visitors that can be merged with those of other days.

    A table to be stored and added to day by day; of a sketch of 2 ** bits buckets the relative standard error is about
    1.04 / sqrt(2 ** bits). Visitors without an address are counted by none."""
    return questions.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("questions"), F.hll_sketch_agg("ip_address", F.lit(bits)).alias("visitors"))


def visitors_in_windows(sketches: DataFrame, ends: DataFrame, days: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """(end, days, questions, visitors): the different visitors of windows that end with each day of ends(end), merged from daily sketches.

    No question is read again: a window is the union of at most as many sketches as it has days. Windows without any
    question have no row. Days and ends meet by the day, as each window names the days that it is made of."""
    windows = ends.select("end").where("end is not null").distinct().withColumn("days", F.explode(F.array(*map(F.lit, days))))
    named = windows.select("end", "days", F.explode(F.sequence(F.date_sub("end", F.col("days") - 1), F.col("end"))).alias("day"))
    out = named.join(sketches, "day").groupBy("end", "days").agg(F.sum("questions").alias("questions"), F.hll_union_agg("visitors").alias("_all"))
    return out.select("end", "days", "questions", F.hll_sketch_estimate("_all").alias("visitors"))


def category_performance(knowledge: DataFrame, categories: DataFrame) -> DataFrame:
    entry = rate(F.col("helpful_yes"), F.col("helpful_yes") + F.col("helpful_no"))
    per = knowledge.groupBy("category_id").agg(F.count("*").alias("entries"), F.sum("hits").alias("hits"), F.round(F.avg(F.when(F.col("helpful_yes") + F.col("helpful_no") > 0, entry)), 1).alias("rating"))
    return categories.select(F.col("id").alias("category_id"), "name").join(per, "category_id")


def period_stats(questions: DataFrame, as_of: str) -> DataFrame:
    """Totals, visitors and match rates of the last 7, 30, 90 and 365 days, in one pass over the longest."""
    spans = questions.where(since(as_of, 365)).select("*", F.explode(F.filter(F.array(*(F.when(since(as_of, d), d) for d in (7, 30, 90, 365))), lambda x: x.isNotNull())).alias("days"))
    out = spans.groupBy("days").agg(F.count("*").alias("questions"), F.countDistinct("ip_address").alias("visitors"), _count(matched()).alias("matched"))
    return out.withColumn("match_rate", rate(F.col("matched"), F.col("questions")))


def latency_stats(metrics: DataFrame) -> DataFrame:
    """Counts, sums and the 50th and 95th percentiles of the total and of every stage, rounded half up."""
    cut = lambda c: [F.round(F.percentile(c, p / 100), 0).cast("long").alias(f"{c}_p{p}") for p in (50, 95)]
    sums = [F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cost")]
    stages = ("kb_ms", "retrieval_ms", "synthesis_ms", "render_ms")
    return metrics.agg(
        F.count("*").alias("n"), F.sum("cache_hit").alias("cache_hits"), F.sum("ai_fallback_fired").alias("ai_fired"), F.sum("gate_fired").alias("gate_fired"), F.count("gate_fired").alias("gate_evaluated"),
        *sums, *cut("total_ms"), *(x for s in stages for x in cut(s)), *(F.count(s).alias(f"{s}_n") for s in stages),
    )


def latency_by(metrics: DataFrame, by: str) -> DataFrame:
    """By layer: count, share in percent and median total. By model: synthesis percentiles, tokens and cost."""
    if by == "matched_layer":
        out = metrics.groupBy(by).agg(F.count("*").alias("n"), F.round(F.percentile("total_ms", 0.5), 0).cast("long").alias("p50"))
        return out.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))
    model = F.coalesce(F.expr("nullif(synthesis_model, '')"), F.lit("unknown"))
    return metrics.where("synthesis_ms is not null").groupBy(model.alias("model")).agg(
        F.count("*").alias("n"), *(F.round(F.percentile("synthesis_ms", p / 100), 0).cast("long").alias(f"p{p}") for p in (50, 95)), F.round(F.percentile("tokens_out", 0.5), 0).cast("long").alias("tokens_p50"), F.sum("cost").alias("cost"),
    )


def rolling_questions(questions: DataFrame, days: int = 7) -> DataFrame:
    """Questions of every day and of the `days` days that end with it."""
    daily = questions.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    number = F.datediff("day", F.lit("1970-01-01"))
    # one row a day, however many questions there are
    return daily.withColumn("trailing", F.sum("n").over(Window.orderBy(number).rangeBetween(-(days - 1), 0)))
