"""Patterns from example phrasings: tokens, scores, discriminators, whole patterns, and what a new run would change.

Everything works on one table of tokens, a row for each token of each variation of each entry. Only the last step of
an entry, which orders and merges its few alternatives, is Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kbspark.functions import text as T
from kbspark.operators import matching as K
from kbspark.sources.tables import written

#: Stems that anchor nothing, verbs and nouns that say little, question words, negations, determiners, and what some
#: words are used as: n noun, v verb, a adjective (fixed values).
ANCHOR_NOISE = "what when where who whom why how which take make do get have want need use look see tell say know think one any".split()
GENERIC_VERBS = "take make do get have want need use work find look see tell say know think give put go come keep let call try ask feel show".split()
INTERROGATIVES = "how what where when who why which whom whose".split()
POLYSEMOUS = "mean so way like kind well sort case part point place side bit lot set order time".split()
NEGATIONS = "not never without cannot no nor neither none".split()
DETERMINERS = "another different every various certain several multiple".split()
USED_AS = {
    "a": "online offline subsidized unsubsidized",
    "n": "website webpage app username smartphone wifi url pdf fafsa sap gpa gi rotc syllabus bursar registrar transcript undergrad undergraduate postgrad pell",
    "nv": "login logout signin signup logon logoff",
    "": "thing something someone somewhere anything anyone",
}
#: Variations of siblings that an anchor's stem may be in.
ANCHOR_SIBLINGS = 4
_VARIATION = ("keyword", "entry_id", "no")


def compiled_tokens(variations: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """(keyword, entry_id, no, idx, stem) of variations(keyword, entry_id, no, text): the words that a pattern may use.

    Words are normalised as questions are, without spelling, once for every different text; forms of the entry's keyword are left
    out. stems(token, stem), if given, has the base form of a word. Written, as most of what follows reads it more than once."""
    words = T.word_synonyms(T.remove_stopwords(T.tokenize(T.normalize_question(F.col("text"))), T.STOPWORDS))
    different = written(variations.select("text").distinct().select("text", words.alias("_w")))
    # a few megabytes may hold millions of phrasings, so they are dealt out before they become rows of words
    rows = variations.repartition(*_VARIATION).join(different, "text").select(*_VARIATION, F.lower(F.trim("keyword")).alias("_k"), F.posexplode("_w").alias("idx", "stem"))
    if stems is not None:
        own = stems.select("token", F.col("stem").alias("_stem"))
        rows = rows.join(own.withColumnRenamed("token", "stem"), "stem", "left").withColumn("stem", F.coalesce("_stem", "stem")).drop("_stem")
        rows = rows.join(own.select(F.col("token").alias("_k"), F.col("_stem").alias("_kstem")), "_k", "left")
    else:
        rows = rows.withColumn("_kstem", F.lit(None).cast("string"))
    k, n = F.col("_k"), F.length("_k")
    cut = lambda m: F.left(k, F.greatest(n - m, F.lit(0)))
    forms = F.array(
        k, F.col("_kstem"), F.concat(k, F.lit("s")), F.when(n >= 3, F.concat(k, F.lit("es"))), F.when((n > 3) & k.endswith("s"), cut(1)), F.when((n > 4) & k.endswith("es"), cut(2)),
        F.when((n > 4) & k.endswith("ies"), F.concat(cut(3), F.lit("y"))),
    )
    return written(rows.where((n == 0) | k.isNull() | ~F.array_contains(F.array_compact(forms), F.col("stem"))).select(*_VARIATION, "idx", "stem"))


def sibling_frequency(tokens: DataFrame) -> DataFrame:
    """(keyword, entry_id, stem, siblings): variations of the keyword's other entries that hold an entry's stem.

    The keyword's total less the entry's own count; a self-join would be quadratic in the keyword's entries."""
    own = tokens.where(F.length("stem") >= 2).select(*_VARIATION, "stem").distinct().groupBy("keyword", "entry_id", "stem").agg(F.count("*").alias("own"))
    return own.withColumn("siblings", F.sum("own").over(Window.partitionBy("keyword", "stem")) - F.col("own")).drop("own")


def shared_anchors(tokens: DataFrame) -> DataFrame:
    """(keyword, entry_id, stem, place): stems in all of an entry's two or more variations, in the order of the first; without
    noise and those that more than ANCHOR_SIBLINGS variations of siblings have."""
    totals = tokens.groupBy("keyword", "entry_id").agg(F.count_distinct("no").alias("total")).where("total >= 2")
    held = tokens.where(F.length("stem") >= 2).groupBy("keyword", "entry_id", "stem", "no").agg(F.min("idx").alias("idx"))
    held = held.groupBy("keyword", "entry_id", "stem").agg(F.count("*").alias("n"), F.min_by("idx", "no").alias("place"))
    held = held.join(totals, ["keyword", "entry_id"]).where((F.col("n") == F.col("total")) & ~F.col("stem").isin(ANCHOR_NOISE))
    return held.join(sibling_frequency(tokens), ["keyword", "entry_id", "stem"]).where(F.col("siblings") <= ANCHOR_SIBLINGS).select("keyword", "entry_id", "stem", "place")


def stem_points(stem: Column, pos: Column, next_pos: Column, siblings: Column, known: Column) -> Column:
    """How well a stem tells its entry from its siblings; pos: letters n, v, a, s, r, or none; known: in the dictionary."""
    has = lambda c, letters: F.regexp_like(c, F.lit(f"[{letters}]"))
    word = F.when(has(pos, "nv"), 3.0).when(has(pos, "as"), 2.0).when(has(pos, "r"), 1.0).otherwise(0.0)
    modifier = F.when(has(pos, "asr") & ~has(pos, "nv") & has(next_pos, "n"), 1.5).otherwise(0.0)
    listed = lambda words, n: F.when(stem.isin(words), n).otherwise(0.0)
    acronym = stem.rlike("^[a-z]{3,6}$") & (pos == "") & ~known & ~stem.isin(GENERIC_VERBS + NEGATIONS + INTERROGATIVES + DETERMINERS)
    return (
        word + modifier + listed(GENERIC_VERBS, -2.0) + listed(POLYSEMOUS, -2.0) + listed(INTERROGATIVES, -5.0) + listed(NEGATIONS, 3.0) + listed(DETERMINERS, 3.0)
        + F.when(acronym, 4.0).otherwise(0.0) + F.greatest(F.lit(0), 5 - siblings)
    )


def with_points(tokens: DataFrame, pos: DataFrame, dictionary: DataFrame, siblings: bool = True) -> DataFrame:
    """tokens with siblings and points, a row for the first place of each stem of two letters or more in a variation.

    pos(word, pos), dictionary(word); siblings: count them, else there are none."""
    used = F.create_map(*(F.lit(x) for kind, words in USED_AS.items() for w in words.split() for x in (w, kind)))
    kinds = pos.groupBy(F.col("word").alias("stem")).agg(F.max("pos").alias("_pos"))
    words = dictionary.select(F.col("word").alias("stem")).distinct().withColumn("_known", F.lit(True))
    rows = tokens.join(kinds, "stem", "left").join(words, "stem", "left").withColumn("_pos", F.coalesce(F.try_element_at(used, F.col("stem")), "_pos", F.lit("")))
    rows = rows.withColumn("_next", F.coalesce(F.lead("_pos").over(Window.partitionBy(*_VARIATION).orderBy("idx")), F.lit("")))
    rows = rows.where(F.length("stem") >= 2).withColumn("_n", F.row_number().over(Window.partitionBy(*_VARIATION, "stem").orderBy("idx"))).where("_n = 1")
    rows = rows.join(sibling_frequency(tokens), ["keyword", "entry_id", "stem"]) if siblings else rows.withColumn("siblings", F.lit(0))
    known = F.coalesce("_known", F.lit(False)) | (F.col("_pos") != "")
    return rows.select(*_VARIATION, "idx", "stem", "siblings", stem_points(F.col("stem"), F.col("_pos"), F.col("_next"), F.col("siblings"), known).alias("points"))


def discriminators(scored: DataFrame, anchors: DataFrame) -> DataFrame:
    """(keyword, entry_id, no, pattern): for every variation the stem that tells it best, with a second one where that is
    good (4 points), too, or where siblings have the first; and the anchors that all variations share."""
    shared = anchors.groupBy("keyword", "entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "stem"))), lambda a: F.concat(a["stem"], F.lit("*"))).alias("_shared"))
    order = [F.desc("points"), "siblings", F.desc(F.length("stem")), "idx"]
    own = scored.join(anchors.select("keyword", "entry_id", "stem"), ["keyword", "entry_id", "stem"], "left_anti")
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy(*_VARIATION).orderBy(*order))).where("_n <= 2")
    at = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    best = own.groupBy(*_VARIATION).agg(at(1, "stem").alias("a"), at(1, "siblings").alias("others"), at(2, "stem").alias("b"), at(2, "points").alias("points"))
    rows = scored.select(*_VARIATION).distinct().join(best, list(_VARIATION), "left").join(shared, ["keyword", "entry_id"], "left")
    second = F.when((F.col("points") >= 4) | (F.col("others") > 0), F.concat("b", F.lit("*")))
    parts = F.concat(F.array_compact(F.array(F.concat("a", F.lit("*")), second)), F.coalesce("_shared", F.array().cast("array<string>")))
    return rows.select(*_VARIATION, F.array_join(parts, "&").alias("pattern")).where("pattern <> ''")


def _words(term: str) -> set[str]:
    return {w.strip() for w in term.replace("*", "").replace("+", "&").split("&")} - {""}


def _absorbed(alternatives: list[str]) -> list[str]:
    """Without those that ask for more words than another that is still there."""
    sets, left = [_words(a) for a in alternatives], list(range(len(alternatives)))
    for i in range(len(alternatives)):
        if any(j != i and sets[j] < sets[i] for j in left):
            left.remove(i)
    return [alternatives[i] for i in left]


def _common(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def _clustered(terms: list[str]) -> list[str]:
    """Terms, sorted; neighbours that share five characters or more become what all of a row of them share."""
    endings = ("ing", "ed", "er", "est", "ly", "ies", "es", "s")
    groups: list[list[str]] = []
    for term in sorted(terms):
        if groups and not term.endswith(endings) and not groups[-1][-1].endswith(endings) and len(_common(groups[-1][-1], term)) >= 5:
            groups[-1].append(term)
        else:
            groups.append([term])
    return [g[0] if len(g) == 1 else _common(g[0], g[-1]) for g in groups]


def joined_pattern(alternatives: list[str], cluster: bool = True) -> str:
    """One pattern of an entry's alternatives, in order: repeats once, single words first and clustered, supersets left out."""
    different = list(dict.fromkeys(alternatives))
    if cluster and len(different) > 1:
        single = [a for a in different if "&" not in a and "+" not in a]
        different = (_clustered(single) if len(single) > 1 else single) + [a for a in different if "&" in a or "+" in a]
    return "|".join(_absorbed(different))


@F.pandas_udf(StringType())
def _joined(alternatives: pd.Series) -> pd.Series:
    return alternatives.map(lambda x: joined_pattern(list(x)))


@F.pandas_udf(StringType())
def _joined_plain(alternatives: pd.Series) -> pd.Series:
    return alternatives.map(lambda x: joined_pattern(list(x), cluster=False))


def _in_order(pattern: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("no", pattern))), lambda x: x[pattern])


def compile_patterns(tokens: DataFrame, pos: DataFrame, dictionary: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """(keyword, entry_id, pattern) of every entry with tokens; scored: what with_points() makes of them, if it is there already."""
    scored = written(with_points(tokens, pos, dictionary)) if scored is None else scored
    picked = discriminators(scored, shared_anchors(tokens))
    return picked.groupBy("keyword", "entry_id").agg(_in_order("pattern").alias("a")).select("keyword", "entry_id", _joined("a").alias("pattern"))


def tier_patterns(variations: DataFrame, tokens: DataFrame, pos: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(keyword, entry_id, pattern, tier): the compiled pattern if it matches all variations of its entry; else the first that
    does of the best 3 stems of each variation, the best 4, and all; else the compiled one again, with tier none."""
    scored = written(with_points(tokens, pos, dictionary))
    ranked = scored.groupBy(*_VARIATION).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("p"), "idx", "stem"))), lambda x: F.concat(x["stem"], F.lit("*"))).alias("s"))
    tiers = {"best3": F.slice("s", 1, 3), "best4": F.slice("s", 1, 4), "all": F.col("s")}
    own = ranked.select(*_VARIATION, *(F.array_join(c, "&").alias(t) for t, c in tiers.items())).groupBy("keyword", "entry_id").agg(*(_in_order(t).alias(t) for t in tiers))
    out = compile_patterns(tokens, pos, dictionary, scored).withColumnRenamed("pattern", "compiled").join(own.select("keyword", "entry_id", *(_joined_plain(t).alias(t) for t in tiers)), ["keyword", "entry_id"])
    texts = variations.select("keyword", "entry_id", "text", K.tokens(F.col("text")).alias("words")).join(out, ["keyword", "entry_id"])
    fits = texts.groupBy("keyword", "entry_id").agg(*(F.bool_and(K.pattern_matches(K.parsed(F.col(t)), F.col("words"), F.col("text"))).alias(f"_{t}") for t in ("compiled", *tiers)))
    rows = out.join(fits, ["keyword", "entry_id"])
    chosen, tier = F.lit(None).cast("string"), F.lit("none")
    for t in reversed(("compiled", *tiers)):
        chosen, tier = F.when(F.col(f"_{t}"), F.col(t)).otherwise(chosen), F.when(F.col(f"_{t}"), t).otherwise(tier)
    return rows.select("keyword", "entry_id", F.coalesce(chosen, "compiled").alias("pattern"), tier.alias("tier"))


def detect_phrases(tokens: DataFrame) -> DataFrame:
    """(keyword, entry_id, phrases): runs of three words in three quarters of an entry's variations and of two in half of them
    (and two at least); the more common, longer and earlier in the alphabet first, none with a word of one before."""
    total = tokens.groupBy("keyword", "entry_id").agg(F.count_distinct("no").alias("total"))
    after = lambda n: F.lead("stem", n).over(Window.partitionBy(*_VARIATION).orderBy("idx"))
    runs = tokens.withColumns({"b": after(1), "c": after(2)}).select(*_VARIATION, F.explode(F.array(F.array("stem", "b"), F.array("stem", "b", "c"))).alias("w"))
    runs = runs.where(F.forall("w", lambda x: x.isNotNull() & (F.length(x) >= 2))).distinct()
    counts = runs.groupBy("keyword", "entry_id", "w").agg(F.count("*").alias("n")).join(total, ["keyword", "entry_id"])
    share = F.col("n") / F.col("total")
    enough = (F.col("total") == 1) | F.when(F.size("w") == 3, share >= 0.75).otherwise((F.col("n") >= 2) & (share >= 0.5))
    row = F.struct((-share).alias("share"), (-F.size("w")).alias("length"), F.array_join("w", " ").alias("phrase"))
    found = counts.where(enough).groupBy("keyword", "entry_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["phrase"]).alias("p"))
    # from the front, a phrase stays if none of its words is in one that stayed before
    words = lambda p: F.split(p, " ")
    kept = F.aggregate("p", F.array().cast("array<string>"), lambda out, p: F.when(F.arrays_overlap(F.flatten(F.transform(out, words)), words(p)), out).otherwise(F.array_append(out, p)))
    return found.select("keyword", "entry_id", kept.alias("phrases"))


def recompile_dryrun(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, old_pattern, new_pattern, status, would_change, reason) for active entries(id, keyword, sub_keyword, status), from
    patterns(entry_id, pattern), which have a row, with an empty pattern if need be, for each entry with variations."""
    rows = entries.where("status = 'active'").join(patterns.select(F.col("entry_id").alias("id"), "pattern", F.lit(True).alias("_known")), "id", "left")
    old, fixed = F.coalesce("sub_keyword", F.lit("")), F.lower("sub_keyword") == "aadefault"
    fixed = F.coalesce(fixed, F.lit(False))
    new = F.when(fixed, old).otherwise(F.coalesce("pattern", F.lit("")))
    change = ~fixed & (new != "") & (new != old)
    status = F.when(fixed, "unchanged").when(new == "", "empty").when(change, "changed").otherwise("unchanged")
    reason = F.when(fixed, "aadefault: the pattern is fixed").when(F.col("_known").isNull(), "no variations to compile against").otherwise("")
    return rows.select("id", old.alias("old_pattern"), new.alias("new_pattern"), status.alias("status"), change.alias("would_change"), reason.alias("reason"))


def suggest_keyword(tokens: DataFrame, pos: DataFrame, dictionary: DataFrame, entries: DataFrame, most: int = 3) -> DataFrame:
    """(entry_id, stem, points, place): the best stems of three letters or more to file a text of compiled_tokens under.

    To a stem's points come 4 if two to fifteen active entries have it as their keyword, 2 for one and 1 for more."""
    counts = entries.where("status = 'active'").groupBy(F.lower("keyword").alias("stem")).agg(F.count("*").alias("n"))
    rows = with_points(tokens, pos, dictionary, siblings=False).where(F.length("stem") >= 3).join(counts, "stem", "left")
    bonus = F.when(F.col("n").between(2, 15), 4.0).when(F.col("n") == 1, 2.0).when(F.col("n") > 15, 1.0).otherwise(0.0)
    rows = rows.withColumn("points", F.col("points") + bonus)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("points"), "idx"))).where(F.col("place") <= most).select("entry_id", "stem", "points", "place")
