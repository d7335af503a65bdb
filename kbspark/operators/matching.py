"""Matching whole logs of questions against a knowledge base of keywords and patterns.

A pattern is OR groups (`|`) of AND parts (`&`); a part is a word, with `*` where anything may stand, or a
phrase of words (`+`). Everything runs on different question texts; candidates come from an equi-join on word
variants, and only candidates are tested. The base's side is broadcast by the optimizer while it is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators.filters import is_bot
from kbspark.operators.joins import containing, resolve_reuse
from kbspark.operators.language import LONG_ENDINGS, SHORT_ENDINGS, normalized_queries
from kbspark.sources.tables import written

KEYWORD_ENDINGS = ["", "s", "es", "ed", "ing", "er", "rs"]


def variants(word: Column) -> Column:
    """The forms of a question's word under which its keyword may be stored."""
    n = F.length(word)
    cut = lambda k, new="": F.concat(F.left(word, F.greatest(n - k, F.lit(0))), F.lit(new))
    rules = [("ing", 5, 3, ""), ("ing", 5, 3, "e"), ("ies", 4, 3, "y"), ("es", 4, 2, ""), ("ed", 4, 2, ""), ("ed", 4, 1, ""), ("s", 4, 1, "")]
    roots = F.array(word, *(F.when(word.endswith(end) & (n > least), cut(k, new)) for end, least, k, new in rules))
    roots = F.filter(F.array_distinct(roots), lambda r: r.isNotNull() & (F.length(r) >= 2))
    return F.array_distinct(F.flatten(F.transform(roots, lambda r: F.array(*(F.concat(r, F.lit(e)) for e in KEYWORD_ENDINGS)))))


def _inflects(base: Column, whole: Column) -> Column:
    """whole is base with an ending that makes another form of it."""
    ending, n = F.substr(whole, F.length(base) + 1), F.length(base)
    return (n >= 3) & whole.startswith(base) & (ending.isin(SHORT_ENDINGS) | (n >= 5) & ending.isin(LONG_ENDINGS))


def term_matches(word: Column, term: Column) -> Column:
    """A word against a pattern's term."""
    plain = (word == term) | _inflects(term, word) | _inflects(word, term) | ((F.length(term) >= 6) & (F.length(word) >= 6) & (F.contains(word, term) | F.contains(term, word)))
    inner = F.concat(F.lit("(?s).*"), F.array_join(F.transform(F.filter(F.split(term, r"\*"), lambda p: p != ""), lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))), ".*"), F.lit(".*"))
    first, last = term.startswith("*"), term.endswith("*")
    wild = (
        F.when(term == "*", True).when(first & last, F.contains(word, F.substr(term, F.lit(2), F.greatest(F.length(term) - 2, F.lit(0))))).when(first, word.endswith(F.substr(term, F.lit(2))))
        .when(last, word.startswith(F.left(term, F.length(term) - 1))).otherwise(F.regexp_like(word, inner))
    )
    return F.when(F.contains(term, F.lit("*")), wild).otherwise(plain)


def any_matches(words: Column, term: Column) -> Column:
    return (term == "") | F.exists(words, lambda w: term_matches(w, term))


def phrase_regex(part: Column) -> Column:
    """A phrase part as a regular expression: its words in a row, `*` at a word's end for more letters."""
    words = F.filter(F.transform(F.split(part, r"\+"), lambda x: F.trim(x)), lambda x: F.regexp_replace(x, r"\*+$", "") != "")
    words = F.transform(words, lambda x: F.concat(F.lit(r"\Q"), F.regexp_replace(x, r"\*+$", ""), F.lit(r"\E"), F.when(x.endswith("*"), r"\w*").otherwise("")))
    return F.concat(F.lit(r"(?iU)\b"), F.array_join(words, r"\s+"), F.lit(r"\b"))


def parsed(pattern: Column) -> Column:
    """array<array<struct<term, phrase, weight>>>: OR groups of AND parts, made once for each entry.

    phrase is a regular expression for phrase parts, else null; weight: how many words a part stands for."""
    split = lambda c, by: F.filter(F.transform(F.split(c, by), lambda x: F.trim(x)), lambda x: x != "")
    stop = F.array(*map(F.lit, T.STOPWORDS))

    def part(x):
        phrase = F.contains(x, F.lit("+"))
        words = F.filter(F.transform(F.split(x, r"\+"), lambda w: F.regexp_replace(F.trim(w), r"\*+$", "")), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
        return F.struct(x.alias("term"), F.when(phrase, phrase_regex(x)).alias("phrase"), F.when(phrase, F.size(words)).otherwise(F.lit(1)).alias("weight"))

    return F.transform(split(F.lower(F.coalesce(pattern, F.lit(""))), r"\|"), lambda g: F.transform(split(g, "&"), part))


def pattern_matches(groups: Column, words: Column, question: Column) -> Column:
    """All parts of some group match: words by term, phrases in the question as it was asked."""
    return F.exists(groups, lambda g: F.forall(g, lambda p: F.when(p["phrase"].isNotNull(), F.regexp_like(question, p["phrase"])).otherwise(any_matches(words, p["term"]))))


def pattern_score(groups: Column, words: Column) -> Column:
    """The best group's score: 10 for every word's weight, 20 and 5 more for several parts, if all parts match as terms.

    A phrase is tested as one term here, `+` included, so a group with a phrase seldom scores."""
    def score(g):
        whole = F.forall(g, lambda p: any_matches(words, p["term"])) & (F.size(g) > 0)
        weight = F.aggregate(g, F.lit(0), lambda n, p: n + p["weight"])
        return F.when(whole, weight * 10 + F.when(F.size(g) > 1, 20 + 5 * (F.size(g) - 1)).otherwise(0)).otherwise(F.lit(0))

    return F.coalesce(F.array_max(F.transform(groups, score)), F.lit(0))


def compiled(entries: DataFrame) -> DataFrame:
    """Entries ready to be matched: keyword in lower case, parsed pattern, whether it is the keyword's default."""
    sub = F.lower(F.trim(F.coalesce("sub_keyword", F.lit(""))))
    return entries.select(F.col("id"), F.lower("keyword").alias("kw"), "hits", "question", "response", sub.isin("", "aadefault").alias("is_default"), parsed(F.col("sub_keyword")).alias("groups"))


def tokens(question: Column, keep: list[str] = ()) -> Column:
    """The words of a question that are matched: normalised, without stopwords, synonyms replaced, no repeats."""
    return F.array_distinct(T.word_synonyms(T.remove_stopwords(T.tokenize(T.normalize_question(question)), T.STOPWORDS), keep))


def keyword_candidates(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, id): entries whose keyword is a variant of one of the question's words."""
    words = questions.select("qid", F.explode("words").alias("w")).where(F.length("w") >= 2)
    forms = words.select("qid", F.explode(variants(F.lower("w"))).alias("kw"))
    return forms.join(entries.select("id", "kw"), "kw").select("qid", "id").distinct()


def match_knowledge(questions: DataFrame, entries: DataFrame, most: int = 5) -> DataFrame:
    """(qid, id, score, hits), at most `most` for a question: for every keyword the best pattern's entry at 100 and
    its score, else the keyword's default entry (the last by id) at 100.

    questions(qid, question, words); entries as compiled() makes them."""
    pairs = keyword_candidates(questions, entries).join(questions, "qid").join(entries.select("id", "kw", "hits", "is_default", "groups"), "id")
    pairs = pairs.where(any_matches(F.col("words"), F.col("kw")))
    hit = F.when(F.col("is_default"), F.lit(0)).when(pattern_matches(F.col("groups"), F.col("words"), F.col("question")), pattern_score(F.col("groups"), F.col("words")))
    pairs = pairs.select("qid", "id", "kw", "hits", "is_default", hit.alias("points")).where("points is not null")
    order = [F.col("is_default").cast("int"), F.desc("points"), F.when(F.col("is_default"), -F.col("id")).otherwise(F.col("id"))]
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "kw").orderBy(*order))).where("_n = 1")
    best = best.select("qid", "id", (F.lit(100) + F.col("points")).alias("score"), "hits")
    return best.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("hits"), "id"))).where(F.col("_n") <= most).drop("_n")


def broad_search(questions: DataFrame, entries: DataFrame, most: int = 5) -> DataFrame:
    """Entries that hold one of the question's words (three letters or more) anywhere, at 50, by hits.

    Only for the questions that nothing else matched. Words are looked for in the different tokens of the entries, not
    in their texts, and those by runs of letters. The limit comes before empty responses are dropped, as it always has."""
    words = questions.select("qid", F.explode(F.array_distinct(F.filter(F.split(F.lower(F.trim("question")), r"\s+"), lambda w: F.length(w) >= 3))).alias("w"))
    whole = entries.select("id", "hits", "response", F.lower(F.concat_ws("\n", "kw", "sub", "question", "response")).alias("body"))
    tokens = whole.select("id", F.explode(F.array_distinct(F.split("body", r"\s+"))).alias("token")).where(F.length("token") >= 3)
    found = containing(words, tokens).join(tokens, "token").select("w", "id").distinct()
    rows = words.join(found, "w").select("qid", "id").distinct().join(whole.select("id", "hits", "response"), "id")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hits"), "id"))).where(F.col("_n") <= most)
    return rows.where(~T.is_effectively_empty(F.col("response"))).select("qid", "id", F.lit(50).alias("score"), "hits")


def base_words(knowledge: DataFrame) -> DataFrame:
    """(word): the words of the base's keywords and patterns, wildcards dropped."""
    both = F.concat_ws(" ", F.lower("keyword"), F.replace(F.lower(F.coalesce("sub_keyword", F.lit(""))), F.lit("*"), F.lit("")))
    return knowledge.select(F.explode(F.split(both, r"[|&+,\s]+")).alias("word")).where(F.length("word") >= 2).distinct()


Step = Callable[[DataFrame], DataFrame]


def find_matches(questions: DataFrame, knowledge: DataFrame, most: int = 5, min_score: int = 0, dictionary: DataFrame | None = None, irregulars: DataFrame | None = None, phrases: list[tuple[str, str]] = (), before_search: Step | None = None, search_results: Step | None = None) -> DataFrame:
    """(id, entry_id, score, place) for a log of questions(id, question).

    Tiers, each for what is still unmatched: all normalising; stopwords removed only; a broad search if
    min_score allows its score. Equal texts are matched once and joined back. With a dictionary(word, ord) the first
    tier has base forms and spelling, too; the base's own words count as right.

    before_search gets the different questions(qid, question) and returns them as they are to be searched; what it leaves out finds
    nothing. search_results gets what was found, (qid, question, entry_id, score, place), question as asked, and returns what counts."""
    entries = compiled(knowledge)
    asked = questions.select("question").where("question is not null").distinct().select(F.xxhash64("question").alias("qid"), "question")
    texts = before_search(asked).select("qid", "question") if before_search else asked
    base = base_words(knowledge)
    known = base.where(F.length("word") >= 3).union(questions.sparkSession.createDataFrame([(w,) for w in T.SYNONYMS], "word string"))
    normalized = normalized_queries(texts, dictionary, irregulars, known, phrases, base=base)
    # each tier reads what the one before has found, and the words several times: written once, not worked out anew
    first = written(match_knowledge(written(normalized), entries, most))
    left = texts.join(first.select("qid").distinct(), "qid", "left_anti")
    left = written(left.withColumn("words", T.remove_stopwords(T.tokenize(T.normalize_question(F.col("question"))), T.STOPWORDS)))
    second = written(match_knowledge(left, entries, most))
    found = first.unionByName(second)
    if min_score <= 50:
        left = left.join(second.select("qid").distinct(), "qid", "left_anti")
        whole = knowledge.select("id", F.col("keyword").alias("kw"), F.col("sub_keyword").alias("sub"), "question", "response", "hits")
        found = found.unionByName(broad_search(left, whole, most))
    found = found.where(F.col("score") >= min_score).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("hits"), "id")))
    found = found.select("qid", F.col("id").alias("entry_id"), "score", "place")
    if search_results:
        found = search_results(found.join(asked, "qid").select("qid", "question", "entry_id", "score", "place")).select("qid", "entry_id", "score", "place")
    log = questions.where("question is not null").select("id", F.xxhash64("question").alias("qid"))
    return log.join(found, "qid").select("id", "entry_id", "score", "place")


def with_responses(matches: DataFrame, knowledge: DataFrame) -> DataFrame:
    """matches(id, entry_id, …) with the response that is served and the entry that it was taken from, if it is another's."""
    served = resolve_reuse(knowledge).select(F.col("id").alias("entry_id"), "response", "reused_from")
    return matches.join(served, "entry_id", "left").select(*matches.columns, "response", "reused_from")


def match_label(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 90, "exact").otherwise("partial")


def logged(questions: DataFrame) -> DataFrame:
    """The questions that a log takes: with a column user_agent those of bots are left out."""
    return questions.where(~is_bot(F.col("user_agent"))) if "user_agent" in questions.columns else questions


def question_log(questions: DataFrame, matches: DataFrame) -> DataFrame:
    """Log rows: every question with its best match, score and label; layer1_strong: above the broad search's score.

    With a column user_agent, questions of bots are not logged."""
    best = matches.where("place = 1").select("id", "entry_id", "score")
    out = logged(questions).join(best, "id", "left")
    return out.withColumns({"match_type": match_label(F.col("score")), "layer1_strong": F.coalesce(F.col("score") > 50, F.lit(False))})


def suggest_questions(questions: DataFrame, entries: DataFrame, per_word: int = 3, most: int = 5) -> DataFrame:
    """For questions(qid, words), those that nothing matched: questions of entries(id, keyword, sub_keyword, question, hits) whose
    keyword or pattern starts with a word, per word the `per_word` most hit."""
    words = questions.select("qid", F.explode("words").alias("w")).where(F.length("w") >= 2)
    # a prefix is found by equality with the keyword's own prefixes
    starts = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.left(c, i))
    own = F.filter(F.array(F.lower("keyword"), F.lower(F.coalesce("sub_keyword", F.lit("")))), lambda c: F.length(c) > 0)
    prefixes = entries.select("id", "hits", F.col("question").alias("suggestion"), F.explode(F.array_distinct(F.flatten(F.transform(own, starts)))).alias("w"))
    rows = words.join(prefixes, "w").withColumn("_n", F.row_number().over(Window.partitionBy("qid", "w").orderBy(F.desc("hits"), "id"))).where(F.col("_n") <= per_word)
    rows = rows.groupBy("qid", "suggestion").agg(F.max("hits").alias("hits"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hits"), "suggestion"))).where(F.col("place") <= most)


def related_questions(questions: DataFrame, entries: DataFrame, matched: DataFrame | None = None, per_keyword: int = 2, most: int = 5) -> DataFrame:
    """(qid, id, points, place): entries that have to do with questions(qid, words), but for the one that was matched(qid, id).

    10 for a word that is the keyword, 5 for one within it, 2 for one within the pattern; three points or more count, and the
    logarithm of the hits is added. entries(id, keyword, sub_keyword, response, hits); two of a keyword at most."""
    asked = questions.select("qid", F.explode(F.transform("words", lambda w: F.lower(w))).alias("w")).where(F.length(F.trim("w")) >= 3)
    own = entries.where(~T.is_effectively_empty(F.col("response"))).select("id", "hits", F.lower("keyword").alias("kw"), F.lower(F.coalesce("sub_keyword", F.lit(""))).alias("sub"))
    in_keyword = containing(asked, own.select(F.col("kw").alias("token"))).select("w", F.col("token").alias("kw"), F.when(F.col("w") == F.col("token"), 10).otherwise(5).alias("n"))
    in_pattern = containing(asked, own.select(F.col("sub").alias("token"))).select("w", F.col("token").alias("sub"), F.lit(2).alias("n"))
    points = asked.join(in_keyword, "w").join(own, "kw").select("qid", "id", "n").unionAll(asked.join(in_pattern, "w").join(own, "sub").select("qid", "id", "n"))
    rows = points.groupBy("qid", "id").agg(F.sum("n").alias("n")).where("n >= 3")
    if matched is not None:
        rows = rows.join(matched.select("qid", "id"), ["qid", "id"], "left_anti")
    rows = rows.join(own, "id").withColumn("points", F.round(F.col("n") + F.log10(F.greatest(F.lit(1), "hits") + 1), 9))
    order = [F.desc("points"), "id"]
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("qid", "kw").orderBy(*order))).where(F.col("_k") <= per_keyword)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("place") <= most).select("qid", "id", "points", "place")


def explain_match(pairs: DataFrame) -> DataFrame:
    """pairs(qid, id, question, words, keyword, sub_keyword) with keyword_matched, matched and status, which has for each
    alternative of the pattern its parts with `+` where one matches and `-` where it does not."""
    sub = F.lower(F.trim(F.coalesce("sub_keyword", F.lit(""))))
    rows = pairs.withColumns({"keyword_matched": any_matches(F.col("words"), F.lower("keyword")), "_default": sub.isin("", "aadefault")})
    parts = lambda g: F.filter(F.transform(F.split(g, r"[&+]"), lambda p: F.trim(p)), lambda p: p != "")
    shown = lambda g: F.concat(F.lit("("), F.array_join(F.transform(parts(g), lambda p: F.concat(p, F.when(any_matches(F.col("words"), p), "+").otherwise("-"))), " and "), F.lit(")"))
    status = F.array_join(F.transform(F.filter(F.split(sub, r"\|"), lambda g: F.trim(g) != ""), shown), " or ")
    whole = F.col("_default") | pattern_matches(parsed(F.col("sub_keyword")), F.col("words"), F.col("question"))
    return rows.withColumns({"matched": F.col("keyword_matched") & whole, "status": F.when(F.col("_default"), "default").otherwise(status)}).drop("_default")


def eval_recall(matches: DataFrame, truth: DataFrame, knowledge: DataFrame | None = None) -> DataFrame:
    """One row for each true (id, entry_id) with `bucket`: correct, wrong_entry, aadefault_fallback or no_match, by the best match.

    aadefault_fallback: another entry, which is its keyword's default; knowledge(id, sub_keyword) tells which are."""
    best = matches.where("place = 1").select("id", F.col("entry_id").alias("got"))
    rows = truth.join(best, "id", "left")
    default = F.lit(False)
    if knowledge is not None:
        rows = rows.join(knowledge.select(F.col("id").alias("got"), F.lower(F.trim("sub_keyword")).alias("_sub")), "got", "left")
        default = F.col("_sub") == "aadefault"
    bucket = F.when(F.col("got").isNull(), "no_match").when(F.col("got") == F.col("entry_id"), "correct").when(default, "aadefault_fallback").otherwise("wrong_entry")
    return rows.withColumn("bucket", bucket).select(*truth.columns, "got", "bucket")


def eval_per_keyword(judged: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(keyword, total, correct, percent, worst) from judged(entry_id, bucket) and knowledge(id, keyword).

    worst: the place among the ten keywords of the lowest percentage, of equal ones those asked most, then by name; else null.
    The ten are picked by a top-k, and joined back."""
    rows = judged.join(knowledge.select(F.col("id").alias("entry_id"), "keyword"), "entry_id")
    out = rows.groupBy("keyword").agg(F.count("*").alias("total"), F.count(F.when(F.col("bucket") == "correct", 1)).alias("correct"))
    out = out.withColumn("percent", F.round(100.0 * F.col("correct") / F.col("total"), 1))
    order = [F.asc("percent"), F.desc("total"), F.asc("keyword")]
    ten = out.orderBy(*order).limit(10).select(F.col("keyword").alias("_k"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("worst"))
    return out.join(F.broadcast(ten), F.col("keyword").eqNullSafe(F.col("_k")), "left").drop("_k")


def eval_failures(judged: DataFrame) -> DataFrame:
    """What was not found right, with what was found instead."""
    return judged.where("bucket <> 'correct'")
