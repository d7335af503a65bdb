"""What a turn of a conversation answers: offers of the assistant that the user takes up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T

#: How an affirmation reads, how one with a question begins, and how an offer begins (fixed values).
AFFIRMATIONS = (
    r"^(yes|yeah|yep|yup|ya|y|yas|yess+)[\s!.]*$", r"^(sure|ok|okay|k|kk|alright|alrighty)[\s!.]*$",
    r"^(tell me more|more|please|go ahead|continue|proceed|sounds good|works for me|that works)[\s!.]*$", r"^(yes please|yes pls|yes thanks|please do|sure thing|sounds great)[\s!.]*$",
    r"^(👍|✅|👌|🙏)+[\s]*$", r"^(yes|yeah|sure|ok|okay)\s*(👍|✅|👌|🙏)+[\s]*$",
)
COMPOUND = r"^(yes|yeah|yep|sure|ok|okay)[,\s]+(.+?)[\s!.?]*$"
ASKING = r"(?<![\p{L}\p{N}_])(what|when|where|why|how|who|which|can|could|do|does|is|are|will|would|should|may)(?![\p{L}\p{N}_])"
CONFIRMING = r"(?i)^(did you mean|were you asking|are you asking)"
OFFERING = r"(?i)^(want to know more about|want to know|would you like to know more about|would you like to know|want to hear about|interested in|curious about)\s+"
_TRAILING = r"[?!. ]+$"


def _bare(c: Column) -> Column:
    """Without white space at both ends, line ends too."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _topic(offer: Column) -> Column:
    """What an offer is about: without its beginning and final marks, the first letter small."""
    def cut(c):
        return F.when(c == "", offer).otherwise(F.concat(F.lower(F.left(c, F.lit(1))), F.substr(c, F.lit(2))))

    return T.let(F.regexp_replace(F.regexp_replace(offer, OFFERING, ""), _TRAILING, ""), cut)


def resolve_followups(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, decision, resolved_query) for every user turn of turns(conv_id, turn, role, text).

    An offer is the last paragraph of the assistant's last turn before, if it ends in a question mark. A plain affirmation
    accepts it, or confirms it if it asked what was meant; one with a question of its own gets the offer's topic before it,
    unless it names it. Without an offer an affirmation stands alone, and anything else is passed on as it is."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("_said", F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(before)).where("role = 'user'")
    last = F.trim(F.element_at(F.split(_bare(T.strip_html(F.col("_said"))), r"\n"), -1))
    rows = rows.withColumn("_last", last)
    rows = rows.withColumn("_offer", F.when(F.col("_last").endswith("?"), F.col("_last")))
    rows = rows.withColumns({"_topic": _topic(F.col("_offer")), "_plain": T.squeeze(F.lower(F.coalesce("text", F.lit(""))))})
    pure = F.col("_plain").rlike("|".join(AFFIRMATIONS))
    rest = F.trim(F.regexp_extract("_plain", COMPOUND, 2))
    rows = rows.withColumns({"_pure": pure, "_rest": F.when(~pure & (rest != "") & (rest.endswith("?") | rest.rlike(ASKING)), rest)})
    bare = F.trim(F.regexp_replace("_rest", _TRAILING, ""))
    scoped = F.when(bare == "", F.col("_topic")).when((F.col("_topic") == "") | F.contains(F.lower(bare), F.lower(F.col("_topic"))), bare).otherwise(F.concat_ws(" ", "_topic", bare))
    offered, asks = F.col("_offer").isNotNull(), F.col("_rest").isNotNull()
    decision = (
        F.when(~F.col("_pure") & ~asks, "not_affirmation").when(asks & offered, "followup_with_question").when(~offered, "affirmation_no_pending_state")
        .when(F.col("_offer").rlike(CONFIRMING), "answer_confirmation").otherwise("followup_acceptance")
    )
    query = F.when(asks & offered, scoped).when(asks, F.col("_rest")).when(F.col("_pure") & offered, F.col("_topic")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", decision.alias("decision"), query.alias("resolved_query"))


def repeated_questions(turns: DataFrame, least: float = 0.85) -> DataFrame:
    """(conv_id, turn, first_turn, similarity): user turns that ask again what an earlier one of their conversation asked.

    turns(conv_id, turn, role, text). Similarity: the earlier turn's tokens that the later one has, repeats counted, over the different
    tokens of both; the most similar earlier turn counts, the first of equal ones. Texts without a token repeat nothing. An earlier
    turn of n tokens, m of them different, shares one of any floor(n - least * m) + 1 different ones with a later turn that is so
    similar. The rarest in the conversation are taken, and turns meet on those alone, so common words and long conversations make few pairs.
    """
    rows = turns.where("role = 'user'").select("conv_id", "turn", T.tokenize(T.dedup_key(F.col("text"))).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumns({"different": F.array_distinct("words"), "n": F.size("words")})
    words = rows.select("conv_id", "turn", "n", F.size("different").alias("m"), F.explode("different").alias("w"))
    counts = words.groupBy(F.col("conv_id").alias("_c"), F.col("w").alias("_w")).agg(F.count("*").alias("df"))
    ranked = words.join(counts, (F.col("w") == F.col("_w")) & F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c", "_w")
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("df", "w"))
    # a token that is missing takes at least 1 of the n from the count, which must reach least * m or more
    prefix = ranked.withColumn("_p", place).where(F.col("_p") <= F.floor(F.col("n") - least * F.col("m") + 1e-9) + 1)
    a, b = prefix.alias("a"), words.alias("b")
    met = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.turn") < F.col("b.turn")) & (F.col("a.n") >= least * F.col("b.m")))
    met = met.select(F.col("b.conv_id").alias("conv_id"), F.col("a.turn").alias("first_turn"), F.col("b.turn").alias("turn")).distinct()
    earlier = rows.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "words", F.col("different").alias("had"))
    later = rows.select(F.col("conv_id").alias("_d"), F.col("turn").alias("_u"), "different")
    met = met.join(earlier, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("first_turn") == F.col("_t")))
    met = met.join(later, F.col("conv_id").eqNullSafe(F.col("_d")) & (F.col("turn") == F.col("_u")))
    met = met.withColumn("similarity", F.size(F.filter("words", lambda x: F.array_contains("different", x))) / F.size(F.array_union("different", "had"))).where(F.col("similarity") >= least)
    return met.groupBy("conv_id", "turn").agg(F.max(F.struct("similarity", -F.col("first_turn"))).alias("b")).select("conv_id", "turn", (-F.col("b.col2")).alias("first_turn"), "b.similarity")
