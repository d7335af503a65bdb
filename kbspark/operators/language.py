"""Stemming and spelling against a dictionary, on tables of different tokens.

Texts are never touched one by one: their tokens are collected once, stemmed or corrected, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import edits
from kbspark.sources.tables import written

#: Endings that make another form of a word (fixed values): for bases of three letters, and of five.
SHORT_ENDINGS = ["", "s", "es", "ies", "ed", "d", "ing", "er", "ers", "est", "ly"]
LONG_ENDINGS = "al ally ful less ness ment ments ion ions tion tions ation ations ity ities ance ence or ors ist ists".split()
#: Suffixes in the order in which they are tried; only the first that fits is (fixed values).
SUFFIXES = ("ing", "ed", "er", "est", "ly", "ies", "es", "s")


def stem_candidates(token: Column) -> Column:
    """What a token may be a form of, the better guess first; empty for three letters or fewer."""
    def cut(n: int) -> Column:
        return F.left(token, F.greatest(F.length(token) - n, F.lit(0)))

    def single(base: Column) -> Column:
        return F.when(F.right(base, F.lit(1)) == F.substr(base, F.greatest(F.length(base) - 1, F.lit(1)), F.lit(1)), F.left(base, F.length(base) - 1))

    forms = {
        "ing": F.array(F.coalesce(single(cut(3)), F.concat(cut(3), F.lit("e")))), "ed": F.array(F.coalesce(single(cut(2)), cut(2))), "ies": F.array(F.concat(cut(3), F.lit("y"))),
        "es": F.array(cut(2), F.concat(cut(2), F.lit("e"))), "er": F.array(cut(2)), "est": F.array(cut(3)), "ly": F.array(cut(2)), "s": F.array(cut(1)),
    }
    out = F.when(F.length(token) <= 3, F.array().cast("array<string>"))
    for suffix in SUFFIXES:
        out = out.when(token.endswith(suffix), forms[suffix])
    return out.otherwise(F.array().cast("array<string>"))


def stem_tokens(tokens: DataFrame, dictionary: DataFrame, irregulars: DataFrame | None = None) -> DataFrame:
    """(token, stem) for tokens(token): the irregular base form, else the first candidate that the dictionary(word)
    has, as it is or without a leading `re`, else the token itself."""
    words = dictionary.select("word").distinct()
    different = tokens.select("token").where("token is not null").distinct()
    tried = different.select("token", F.posexplode(stem_candidates(F.col("token"))).alias("at", "candidate"))
    tried = tried.withColumn("word", F.explode(F.array_compact(F.array("candidate", F.when(F.col("candidate").startswith("re"), F.substr("candidate", F.lit(3)))))))
    known = tried.join(words, "word").groupBy("token").agg(F.min_by("candidate", "at").alias("found"))
    out = different.join(known, "token", "left")
    if irregulars is not None:
        out = out.join(irregulars.groupBy(F.col("form").alias("token")).agg(F.min("base").alias("base")), "token", "left")
        return out.select("token", F.coalesce("base", "found", "token").alias("stem"))
    return out.select("token", F.coalesce("found", "token").alias("stem"))


def inflected(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Those of tokens(token) that are one of words(word) with an ending that makes another form of it."""
    token = F.col("token")
    bases = [F.when(token.endswith(e) & (F.length(token) - len(e) >= least), F.left(token, F.length(token) - len(e))) for endings, least in ((SHORT_ENDINGS[1:], 3), (LONG_ENDINGS, 5)) for e in endings]
    tried = tokens.select("token").distinct().select("token", F.explode(F.array_compact(F.array(*bases))).alias("word"))
    return tried.join(words.select("word").distinct(), "word", "left_semi").select("token").distinct()


def spell_correct(tokens: DataFrame, dictionary: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(token, correction, distance) for tokens that the dictionary(word, ord) lacks and that are near one of its words.

    Near: two edits for six letters or more, else one; of equally near words the first in the dictionary. Tokens of
    two letters or fewer, without a vowel or of digits alone are left alone, and so are those that are known(word) (keywords, words
    of patterns, canonical words of synonyms) and forms of such a word or one of the dictionary. Tokens and words meet
    on what is left of each without a letter or two."""
    words = dictionary.groupBy("word").agg(F.min("ord").alias("ord"))
    right = words.select("word") if known is None else words.select("word").union(known.select("word"))
    different = tokens.select("token").where(F.length("token") > 2).distinct().where(F.col("token").rlike("[aeiouy]")).join(right.select(F.col("word").alias("token")).distinct(), "token", "left_anti")
    different = different.join(inflected(different, right), "token", "left_anti")
    near = edits.near(different, words, lambda token, word: F.when(token >= 6, 2).otherwise(1)).where("distance >= 1").join(words, "word")
    best = near.groupBy("token").agg(F.min(F.struct("distance", "ord", "word")).alias("b"))
    return best.select("token", F.col("b.word").alias("correction"), "b.distance")


#: Of the longer of two words, so much must be the shorter one at its beginning; both have so many letters.
COVERED, COVERS = 0.8, 4


def covered(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """Those of tokens(token) that a word of base(word) stands for: the word itself, or one of which the other is the beginning
    and COVERED of its length. They meet by equality, with the beginnings of the longer of the two."""
    def beginnings(c):
        n = F.length(c)
        least = F.greatest(F.ceil(n * COVERED - 1e-9), F.lit(COVERS)).cast("int")
        return F.array_distinct(F.concat(F.array(c), F.when(least <= n, F.transform(F.sequence(least, n), lambda i: F.left(c, i))).otherwise(F.array().cast("array<string>"))))

    own, words = tokens.select("token").distinct(), base.select("word").where("word <> ''").distinct()
    begun = own.join(words.select(F.explode(beginnings(F.col("word"))).alias("token")).distinct(), "token", "left_semi")
    begins = own.select("token", F.explode(beginnings(F.col("token"))).alias("word")).join(words, "word", "left_semi").select("token")
    return begun.union(begins).distinct()


def beside_base(tokens: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(token, word): the word whose list of synonyms has the token, but the token itself if the base covers it."""
    replaced = tokens.select("token").distinct().select("token", T.word_synonyms(F.array("token"))[0].alias("word"))
    if base is None:
        return replaced
    asked = replaced.where("word <> token")
    stay = covered(asked, base).select("token", F.lit(True).alias("_stays"))
    return replaced.join(stay, "token", "left").select("token", F.when(F.col("_stays"), F.col("token")).otherwise(F.col("word")).alias("word"))


def normalized_queries(questions: DataFrame, dictionary: DataFrame | None = None, irregulars: DataFrame | None = None, known: DataFrame | None = None, phrases: list[tuple[str, str]] = (), stopwords: list[str] = T.STOPWORDS, base: DataFrame | None = None, spelling: bool = True) -> DataFrame:
    """questions(qid, question) with `words`: all that is done to a question before it is matched, in order.

    Contractions and characters, phrases, stopwords, synonyms (a token that base(word) covers stays), base forms, runs of a character, spelling
    (base forms and what follows only with a dictionary(word, ord), the last two only with `spelling`). What is done to single words is worked
    out for the different tokens and joined back."""
    first = T.remove_stopwords(T.tokenize(T.replace_phrases(T.normalize_question(F.col("question")), list(phrases))), stopwords)
    rows = written(questions.select("qid", F.posexplode(first).alias("at", "token")))
    words = beside_base(rows.select("token"), base)
    if dictionary is not None:
        stems = stem_tokens(words.select(F.col("word").alias("token")), dictionary, irregulars).withColumnRenamed("token", "word")
        words = written(words.join(stems, "word").select("token", F.col("stem").alias("word")))
        if spelling:
            words = words.withColumn("word", T.collapse_repeats(F.col("word")))
            fixed = spell_correct(words.select(F.col("word").alias("token")), dictionary, known).select(F.col("token").alias("word"), "correction")
            words = words.join(fixed, "word", "left").select("token", F.coalesce("correction", "word").alias("word"))
    found = rows.join(words, "token").groupBy("qid").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("words"))
    return questions.join(found, "qid", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


#: Keys beside each key of a keyboard (fixed values).
NEIGHBOURS = {
    "q": "wa", "w": "qeas", "e": "wrsd", "r": "etdf", "t": "ryfg", "y": "tugh", "u": "yihj", "i": "uojk", "o": "ipkl", "p": "ol", "a": "qwsz", "s": "awedxz", "d": "serfcx", "f": "drtgvc",
    "g": "ftyhbv", "h": "gyujnb", "j": "huikmn", "k": "jiolm", "l": "kop", "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
}


def similar_words(tokens: DataFrame, dictionary: DataFrame, least: float, most: int) -> DataFrame:
    """(token, word, similarity, place): the `most` words of dictionary(word, ord) nearest to each of tokens(token).

    Words that begin with the token's letter or with one beside it on the keyboard, of a length that differs by two at
    most; similarity: 100 less the edits in hundredths of the longer one. Tokens and words meet by the index of edits, the
    number of which the least similarity and the length allow."""
    beside = F.create_map(*(x for k, v in NEIGHBOURS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    letter = F.left("token", F.lit(1))
    firsts = F.concat(F.array(letter), F.coalesce(F.try_element_at(beside, letter), F.array().cast("array<string>")))
    allowed = lambda token, word: F.floor(F.greatest(token, word) * (1 - least / 100) + 1e-9).cast("int")
    words = dictionary.groupBy("word").agg(F.min("ord").alias("ord"))
    pairs = edits.near(tokens, words, allowed).where(F.array_contains(firsts, F.left("word", F.lit(1)))).join(words, "word")
    near = pairs.withColumn("similarity", F.round((1 - F.col("distance") / F.greatest(F.length("token"), F.length("word"))) * 100, 6)).where(F.col("similarity") >= least)
    return near.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("similarity"), "ord", "word"))).where(F.col("place") <= most).select("token", "word", "similarity", "place")


def spellcheck_words(tokens: DataFrame, dictionary: DataFrame, synonyms: DataFrame, least: float = 75.0) -> DataFrame:
    """(token, word): what the older checker makes of tokens(token).

    A token that is a variant in synonyms(variant, canonical) becomes the canonical word; `*` in a variant stands for any
    letters, and only the part beside it is replaced. Else the most similar dictionary word, `least` or more, if the token is not one
    itself; its own synonym after that."""
    plain = synonyms.where(~F.contains("variant", F.lit("*"))).groupBy(F.col("variant").alias("token")).agg(F.min("canonical").alias("canonical"))
    wild = synonyms.where(F.contains("variant", F.lit("*"))).select("variant", "canonical", F.replace("variant", F.lit("*"), F.lit("")).alias("part"), F.col("variant").startswith("*").alias("front"), F.col("variant").endswith("*").alias("back"))
    different = tokens.select("token").where("token <> ''").distinct()
    fits = F.when(F.col("front") & F.col("back"), F.contains("token", F.col("part"))).when(F.col("front"), F.col("token").endswith(F.col("part"))).otherwise(F.col("token").startswith(F.col("part")))
    # the table of wildcards is a tenant's own list of some hundred rows; its size is checked before it is sent everywhere
    wild = F.broadcast(wild) if wild.limit(10_001).count() <= 10_000 else wild
    partly = different.join(wild, fits).groupBy("token").agg(F.min_by(F.replace("token", F.col("part"), F.col("canonical")), "variant").alias("partly"))
    known = dictionary.select(F.col("word").alias("token"), F.lit(True).alias("known")).distinct()
    near = similar_words(different.join(known, "token", "left_anti"), dictionary, least, 1).select("token", F.col("word").alias("near"))
    own = plain.select(F.col("token").alias("near"), F.col("canonical").alias("then"))
    rows = different.join(plain, "token", "left").join(partly, "token", "left").join(near, "token", "left").join(own, "near", "left")
    return rows.select("token", F.coalesce("canonical", "partly", "then", "near", "token").alias("word"))
