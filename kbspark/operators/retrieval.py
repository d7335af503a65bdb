"""Retrieval over chunks: full text, vectors, their fusion; citations for answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators.fulltext import fulltext_in_sources
from kbspark.operators.joins import containing, first_per_source
from kbspark.operators.overlap import most_shared
from kbspark.sources.tables import written

#: Fusion constant, chunks kept, depth of each list, and the similarity at or under which nothing is returned.
RRF_K, KEEP, DEPTH, GATE = 60, 6, 20, 0.35


def _top(rows: DataFrame, by: str, score: str, id_: str, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), id_))).where(F.col("rank") <= k)


def best_chunks(chunks: DataFrame, queries: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, source_id, chunk_id) for pairs(query_id, source_id, hint): the source's chunk that answers best.

    chunks(chunk_id, source_id, chunk_index, content). Of the source's `most` chunks of the highest relevance the one that
    scores highest for the question counts (the more relevant of equal ones); without any the hint, if there is such a
    chunk, and else the source's first chunk."""
    near = written(fulltext_in_sources(chunks, queries, pairs, most))
    # a long chunk is near to many questions: it is looked through once
    bodies = chunks.join(near.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", T.answer_body(F.col("content")).alias("body"))
    asked = queries.select("query_id", T.search_terms(F.col("query")).alias("terms"))
    points = 2 * T.terms_held(F.col("body.runs"), F.col("terms")) + F.col("body.signs")
    best = near.join(bodies, "chunk_id").join(asked, "query_id").withColumn("points", points).groupBy("query_id", "source_id").agg(F.max_by("chunk_id", F.struct("points", -F.col("rank"))).alias("best"))
    hints = chunks.select(F.col("chunk_id").alias("hint"), F.lit(True).alias("known"))
    firsts = chunks.groupBy("source_id").agg(F.min_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("first"))
    out = pairs.join(best, ["query_id", "source_id"], "left").join(hints, "hint", "left").join(firsts, "source_id", "left")
    return out.select("query_id", "source_id", F.coalesce("best", F.when(F.col("known"), F.col("hint")), "first").alias("chunk_id"))


def rrf_merge(vector: DataFrame, fulltext: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, rrf, rank): the sum of 1 / (k + rank) over both lists; ties by the vector list's order, then the other's."""
    both = vector.select("query_id", "chunk_id", "rank", F.lit(0).alias("list")).union(fulltext.select("query_id", "chunk_id", "rank", F.lit(1).alias("list")))
    out = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf"), F.min(F.struct("list", "rank")).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first"))
    return out.withColumn("rank", place).drop("first")


def hybrid_retrieve(vector: DataFrame, fulltext: DataFrame, sources: DataFrame | None = None, keep: int = KEEP, gate: float = GATE) -> DataFrame:
    """(query_id, chunk_id, relevance, rank): nothing where the best similarity is at or under the gate, the fusion else.

    relevance is 1 / (60 + place) to 6 digits, not the sum. sources(chunk_id, status), if given, drops chunks whose
    source is not indexed, after the cut."""
    shut = vector.groupBy("query_id").agg(F.max("similarity").alias("top")).where(F.col("top") <= gate)
    merged = rrf_merge(vector, fulltext).join(shut, "query_id", "left_anti").where(F.col("rank") <= keep)
    out = merged.select("query_id", "chunk_id", F.round(1.0 / (RRF_K + F.col("rank")), 6).alias("relevance"), "rank")
    return out.join(sources.where("status = 'indexed'").select("chunk_id"), "chunk_id", "left_semi") if sources is not None else out


def merge_expanded(first: DataFrame, second: DataFrame, weight: float = 1.2) -> DataFrame:
    """Results of a query and of its expansion: the sum, the second's weighted, where both have a chunk; else its own."""
    a, b = first.withColumnRenamed("relevance", "x").select("query_id", "chunk_id", "x"), second.withColumnRenamed("relevance", "y").select("query_id", "chunk_id", "y")
    both = a.join(b, ["query_id", "chunk_id"], "full")
    return both.select("query_id", "chunk_id", F.round(F.when(F.col("x").isNull(), F.col("y")).when(F.col("y").isNull(), F.col("x")).otherwise(F.col("x") + weight * F.col("y")), 6).alias("relevance"))


def _holding(chunks: DataFrame, asked: DataFrame, apart: str) -> DataFrame:
    """(query_id, chunk_id): chunks that hold a word of asked(query_id, w) anywhere; words and chunks are split by `apart`."""
    postings = chunks.select("chunk_id", F.explode(F.array_distinct(F.split(F.lower("content"), apart))).alias("token")).where(F.length("token") >= 3)
    found = containing(asked, postings)
    return asked.join(found, "w").join(postings, "token").select("query_id", "chunk_id").distinct()


def _first_words(queries: DataFrame, apart: str, words: int) -> DataFrame:
    return queries.select("query_id", F.slice(F.filter(F.split(F.lower("query"), apart), lambda w: F.length(w) >= 4), 1, words).alias("words"))


def like_fallback(chunks: DataFrame, queries: DataFrame, words: int = 5, k: int = DEPTH) -> DataFrame:
    """(query_id, chunk_id, rank): chunks that hold one of the query's first words of four letters or more, by id."""
    asked = _first_words(queries, r"\W+", words).select("query_id", F.explode("words").alias("w")).distinct()
    rows = _holding(chunks, asked, r"\W+")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where(F.col("rank") <= k)


def simple_retrieve(chunks: DataFrame, queries: DataFrame, words: int = 5, k: int = 5) -> DataFrame:
    """(query_id, chunk_id): as like_fallback with words between blanks; for a query without such words the newest chunks."""
    own = _first_words(queries, r"\s+", words)
    asked = own.select("query_id", F.explode("words").alias("w")).distinct()
    rows = _holding(chunks, asked, r"\s+").withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where(F.col("_n") <= k)
    newest = chunks.select("chunk_id").orderBy(F.desc("chunk_id")).limit(k)  # k rows
    return rows.select("query_id", "chunk_id").union(own.where(F.size("words") == 0).select("query_id").crossJoin(F.broadcast(newest)))


def contact_chunks(chunks: DataFrame, retrieved: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, chunk_id, score): chunks with contact details that share the topic of what was retrieved.

    Topic words: four letters or more, twice or more in the retrieved chunks. Score: topic words held, and 10 in
    a source that was retrieved; other sources need one word. chunks(chunk_id, source_id, content)."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: (F.length(w) >= 4) & ~w.isin(T.STOPWORDS))
    held = written(retrieved.select("query_id", "chunk_id").join(chunks, "chunk_id").select("query_id", "chunk_id", "source_id", words(F.col("content")).alias("words")))  # a few chunks a query
    topic = held.select("query_id", F.explode("words").alias("w")).groupBy("query_id", "w").agg(F.count("*").alias("n")).where("n >= 2").groupBy("query_id").agg(F.collect_list("w").alias("words"))
    asked = held.groupBy("query_id").agg(F.collect_set("source_id").alias("sources"), F.collect_set("chunk_id").alias("own")).join(topic, "query_id", "left")
    asked = written(asked.withColumn("words", F.coalesce("words", F.array().cast("array<string>"))))
    # texts are looked through once
    contact = written(chunks.where(T.has_contact_info(F.col("content"))).select("chunk_id", "source_id", F.array_distinct(words(F.col("content"))).alias("words")))
    return most_shared(contact, asked, most, 10)


def find_relevant_chunks(chunks: DataFrame, queries: DataFrame, hybrid: DataFrame, fulltext: DataFrame, expanded: DataFrame | None = None, keep: int = KEEP, search_results: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, chunk_id, tier, rank): the fused list where it has anything; else the full text's, merged with those of an
    expanded query if there are any; else like_fallback. To the first two are added the contact chunks, as a tier.

    hybrid(query_id, chunk_id, rank), fulltext and expanded(query_id, chunk_id, relevance). search_results gets these rows and returns
    those that count. (What is to be done before a search is done to the queries, before the lists are made.)"""
    first = hybrid.select("query_id", "chunk_id", F.lit("hybrid").alias("tier"), "rank")
    full = merge_expanded(fulltext, expanded) if expanded is not None else fulltext.select("query_id", "chunk_id", "relevance")
    full = _top(full.join(first.select("query_id").distinct(), "query_id", "left_anti"), "query_id", "relevance", "chunk_id", keep)
    both = written(first.unionByName(full.select("query_id", "chunk_id", F.lit("fulltext").alias("tier"), "rank")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    out = both.unionByName(contact_chunks(chunks, both).select("query_id", "chunk_id", F.lit("contact").alias("tier"), place.alias("rank")))
    left = written(queries.join(both.select("query_id").distinct(), "query_id", "left_anti"))
    if not left.isEmpty():  # else all texts would be taken apart for nothing
        out = out.unionByName(like_fallback(chunks, left, k=keep).select("query_id", "chunk_id", F.lit("like").alias("tier"), "rank"))
    return search_results(out).select(*out.columns) if search_results else out


def diagnostics(vector: DataFrame, fulltext: DataFrame, gate: float = GATE) -> DataFrame:
    """Per query: sizes of both lists, the best similarity, how many chunks both have, and whether the gate fired."""
    v = vector.groupBy("query_id").agg(F.count("*").alias("vector_count"), F.max("similarity").alias("top_similarity"), F.collect_set("chunk_id").alias("a"))
    t = fulltext.groupBy("query_id").agg(F.count("*").alias("fulltext_count"), F.collect_set("chunk_id").alias("b"))
    out = v.join(t, "query_id", "full")
    return out.select("query_id", F.coalesce("vector_count", F.lit(0)).alias("vector_count"), F.coalesce("fulltext_count", F.lit(0)).alias("fulltext_count"), "top_similarity", F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0)).alias("overlap_count"), F.coalesce(F.col("top_similarity") <= gate, F.lit(False)).alias("gate_fired"))


def answer_phrases(answer: Column) -> Column:
    """Different runs of three words with at most one stopword."""
    def phrases(w):
        grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.slice(w, i, 3))).otherwise(F.array().cast("array<array<string>>"))
        return F.array_distinct(F.transform(F.filter(grams, lambda g: F.size(F.filter(g, lambda x: ~x.isin(T.STOPWORDS))) >= 2), lambda g: F.array_join(g, " ")))

    return T.let(T.tokenize(T.dedup_key(answer)), phrases)


def answer_words(answer: Column) -> Column:
    return F.array_distinct(F.filter(T.tokenize(T.dedup_key(answer)), lambda x: (F.length(x) >= 4) & ~x.isin(T.STOPWORDS)))


def overlap_scores(candidates: DataFrame) -> DataFrame:
    """candidates(answer_id, answer, source_id, chunk_id, position, content) -> their keys with phrase_score (5 for every
    phrase of the answer that the chunk holds) and overlap_score (that and 1 for every word).

    Answers and chunks are taken apart once each, and then meet."""
    answers = candidates.select("answer_id", "answer").dropDuplicates(["answer_id"]).select("answer_id", answer_phrases(F.col("answer")).alias("_p"), answer_words(F.col("answer")).alias("_w"))
    bodies = candidates.select("chunk_id", "content").dropDuplicates(["chunk_id"]).select("chunk_id", T.dedup_key(T.strip_html(F.col("content"))).alias("_body"))
    rows = candidates.select("answer_id", "source_id", "chunk_id", "position").join(answers, "answer_id").join(bodies, "chunk_id")
    held = lambda c: F.size(F.filter(c, lambda p: F.contains(F.col("_body"), p)))
    rows = rows.select("answer_id", "source_id", "chunk_id", "position", (5 * held(F.col("_p"))).alias("phrase_score"), held(F.col("_w")).alias("_words"))
    return rows.withColumn("overlap_score", F.col("phrase_score") + F.col("_words")).drop("_words")


def select_citations(candidates: DataFrame, judged: DataFrame | None = None, most: int = 3) -> DataFrame:
    """candidates(answer_id, answer, source_id, chunk_id, position, content) -> which sources an answer used.

    The first chunk of every source stands for it. Where exactly one source has a phrase of the answer the overlap decides (a
    phrase is enough); else the scores of a judge(answer_id, source_id, llm_score), of which 0.5 is enough, and the
    overlap again for answers that have not been judged. At most `most` sources of an answer are used: by the judge's
    score, then the overlap, then the position."""
    rows = overlap_scores(first_per_source(candidates.where("source_id > 0")))
    hits = F.sum((F.col("phrase_score") > 0).cast("int")).over(Window.partitionBy("answer_id"))
    rows = rows.withColumn("_hits", hits)
    if judged is not None:
        rows = rows.join(judged.select("answer_id").distinct().withColumn("_judged", F.lit(True)), "answer_id", "left")
        rows = rows.join(judged.groupBy("answer_id", "source_id").agg(F.max("llm_score").alias("_score")), ["answer_id", "source_id"], "left")
    else:
        rows = rows.withColumns({"_judged": F.lit(None).cast("boolean"), "_score": F.lit(None).cast("double")})
    rows = rows.withColumn("route", F.when(F.col("_hits") == 1, "heuristic").when(F.col("_judged"), "llm").otherwise("fallback"))
    rows = rows.withColumn("llm_score", F.when(F.col("route") == "llm", F.col("_score")))
    rows = rows.withColumn("_used", F.coalesce(F.when(F.col("route") == "llm", F.col("llm_score") >= 0.5).otherwise(F.col("phrase_score") >= 5), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("answer_id", "_used").orderBy(F.desc_nulls_last("llm_score"), F.desc("overlap_score"), "position"))
    return rows.withColumn("used_in_answer", (F.col("_used") & (place <= most)).cast("int")).drop("_hits", "_used", "_judged", "_score")
