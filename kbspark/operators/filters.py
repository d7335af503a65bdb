"""Filters and lookups over the question log, the knowledge base and its side tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import is_effectively_empty
from kbspark.operators.analytics import matched as is_matched

#: Substrings of bots' user agents, in lower case (fixed values).
BOT_AGENTS = (
    "googlebot bingbot slurp duckduckbot baiduspider yandexbot sogou exabot facebot ia_archiver facebookexternalhit twitterbot linkedinbot pinterest slackbot telegrambot whatsapp discordbot semrushbot ahrefsbot"
    " mj12bot dotbot rogerbot seokicks sistrix blexbot dataforseo bot crawl spider scraper fetch curl wget python-requests python-urllib java/ libwww httpclient go-http-client headlesschrome phantomjs selenium"
    " puppeteer applebot petalbot bytespider gptbot claudebot anthropic ccbot archive.org_bot mediapartners-google adsbot-google apis-google"
).split() + ["screaming frog"]


def filter_questions(questions: DataFrame, matched: bool | None = None, rejected: bool = False, language: str | None = None, contains: str | None = None, page: int = 0, size: int = 50) -> DataFrame:
    """A page of the log, newest first; language 'non_en' takes all that is known and not English."""
    if matched is not None:
        questions = questions.where(is_matched() if matched else ~is_matched())
    if rejected:
        questions = questions.where("ai_rejected = 1")
    if language == "non_en":
        questions = questions.where("detected_language <> '' and detected_language <> 'en'")
    elif language:
        questions = questions.where(F.col("detected_language") == language)
    if contains:
        questions = questions.where(F.lower("question").contains(contains.lower()))
    return questions.orderBy(F.desc("created_at"), F.desc("id")).offset(page * size).limit(size)


def filter_knowledge(knowledge: DataFrame, status: str | None = None, letter: str | None = None, search: str | None = None, sort: str = "keyword") -> DataFrame:
    """Entries by status, first letter of the keyword (`0-9` for digits) and text; sort: an allowed column."""
    if sort not in ("keyword", "hits", "id", "status"):
        raise ValueError(f"not a column to sort by: {sort}")
    if status:
        knowledge = knowledge.where(F.col("status") == status)
    if letter:
        knowledge = knowledge.where(F.col("keyword").rlike("^[0-9]") if letter == "0-9" else F.lower(F.substring("keyword", 1, 1)) == letter.lower())
    if search:
        fields = [F.lower(F.coalesce(c, F.lit(""))).contains(search.lower()) for c in ("keyword", "sub_keyword", "question", "response")]
        knowledge = knowledge.where(fields[0] | fields[1] | fields[2] | fields[3])
    return knowledge.orderBy(sort, "id")


def servable_entries(knowledge: DataFrame, as_of: str) -> DataFrame:
    """Active entries that have not expired and whose response is not empty once markup is gone."""
    live = F.col("expires_at").isNull() | (F.col("expires_at") > F.expr(f"date '{as_of[:10]}'"))
    return knowledge.where((F.col("status") == "active") & live & ~is_effectively_empty(F.col("response")))


def inquiry_queue(inquiries: DataFrame, limit: int = 100) -> DataFrame:
    """Pending first, then the newest."""
    return inquiries.orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), F.desc("created_at"), "id").limit(limit)


def lead_search(leads: DataFrame, identity: str | None = None, contains: str | None = None) -> DataFrame:
    if identity:
        leads = leads.where(F.col("identity") == identity)
    if contains:
        leads = leads.where(F.lower("name").contains(contains.lower()) | F.lower("email").contains(contains.lower()))
    return leads


def is_bot(agent: Column) -> Column:
    """An empty user agent, or one that holds a bot's name."""
    return (F.coalesce(agent, F.lit("")) == "") | F.lower(agent).rlike("|".join(map(re.escape, BOT_AGENTS)))


_IP = r"^\d{1,3}(\.\d{1,3}){3}$"


def client_ip(connecting: Column, forwarded: Column, real: Column, remote: Column) -> Column:
    """The first valid address of four headers (the first of the forwarded list), else 127.0.0.1."""
    def valid(c):
        return F.when(c.rlike(_IP) & F.forall(F.split(c, r"\."), lambda x: x.try_cast("int") <= 255), c)

    return F.coalesce(*(valid(F.trim(c)) for c in (connecting, F.split(forwarded, ",")[0], real, remote)), F.lit("127.0.0.1"))


def crawl_due(sources: DataFrame, as_of: str, most: int = 10) -> DataFrame:
    """Indexed sources whose refresh interval has passed, at most `most` for each interval, the longest waiting first."""
    days = sources.sparkSession.createDataFrame([("daily", 1), ("weekly", 7), ("twice_monthly", 15), ("monthly", 30)], "refresh_interval string, days int")
    due = sources.where("status = 'indexed'").join(F.broadcast(days), "refresh_interval")
    due = due.where(F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < F.expr(f"timestamp '{as_of}' - make_dt_interval(days)")))
    place = F.row_number().over(Window.partitionBy("refresh_interval").orderBy(F.asc_nulls_first("last_crawled_at"), "id"))
    return due.withColumn("place", place).where(F.col("place") <= most).drop("days")


def trial_status(tenants: DataFrame, as_of: str) -> DataFrame:
    """Days left of trials, and warn_7d, warn_1d, grace or suspended."""
    seconds = F.unix_timestamp("trial_end") - F.unix_timestamp(F.expr(f"timestamp '{as_of}'"))
    out = tenants.where("status = 'trial' and trial_end is not null").withColumn("days_remaining", F.floor(seconds / 86400))
    d = F.col("days_remaining")
    state = F.when(d < -3, "suspended").when(d < 0, "grace").when(d <= 1, "warn_1d").when(d <= 7, "warn_7d").otherwise("active")
    return out.withColumn("state", state)


def faq_list(knowledge: DataFrame, categories: DataFrame, name: str, as_of: str, limit: int = 20) -> DataFrame:
    own = categories.where(F.col("name") == name).select(F.col("id").alias("category_id"))
    return servable_entries(knowledge, as_of).join(F.broadcast(own), "category_id", "left_semi").orderBy(F.desc("hits"), "id").limit(limit)


def category_tree(categories: DataFrame, depth: int = 5) -> DataFrame:
    """id, depth and path of every category; a level is a join of the frontier with its children."""
    level = categories.where("parent_id is null").select("id", F.lit(0).alias("depth"), F.col("name").alias("path"))
    out = level
    for d in range(1, depth):
        level = categories.alias("c").join(level.alias("p"), F.col("c.parent_id") == F.col("p.id")).select("c.id", F.lit(d).alias("depth"), F.concat_ws("/", "p.path", "c.name").alias("path"))
        out = out.unionByName(level)
    return out
