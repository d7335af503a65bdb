"""Words within a few edits of each other: an index of deletions, and of segments where deletions would be too many.

Two words that are n edits apart have a string in common that each becomes by deleting n letters at most, so the words of
a dictionary and those that are looked up meet on such strings, by equality. A word has about half its length squared of
them for n = 2; for longer words and more edits the dictionary's word is cut into n + 1 segments instead, one of
which no edit touches, and meets those that have it within n places of its own. Either way what meets is verified by the distance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths differ by so much at most. Words of so many letters are met by deletions, of which each has so many.
APART, LETTERS, DELETED = 2, 20, 2
Bound = Callable[[Column, Column], Column]


def _without(word: Column, at: Column) -> Column:
    return F.concat(F.left(word, at - 1), F.substr(word, at + 1))


def deletions(word: Column, most: Column) -> Column:
    """Hashes of the word and of what it is without one or two of its letters, two if `most` says so."""
    n = F.length(word)
    none = F.array().cast("array<string>")
    once = F.when((most >= 1) & (n >= 1), F.transform(F.sequence(F.lit(1), n), lambda i: _without(word, i))).otherwise(none)
    twice = F.when(
        (most >= 2) & (n >= 2), F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: _without(_without(word, i), j))))
    ).otherwise(none)
    return F.array_distinct(F.transform(F.concat(F.array(word), once, twice), lambda x: F.xxhash64(x)))


def _segment(n: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """The start (from 0) and length of segment i of a word of n letters in so many parts, the last ones the longer."""
    short, long = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    longer = F.greatest(i - (parts - long), F.lit(0))
    return i * short + longer, short + F.when(i >= parts - long, 1).otherwise(0)


def _segments(word: Column, most: Column) -> Column:
    n, parts = F.length(word), most + 1

    def key(i):
        start, size = _segment(n, parts, i)
        return F.xxhash64(n, i, F.substr(word, start + 1, size))

    return F.transform(F.sequence(F.lit(0), most), key)


def _segments_within(token: Column, n: Column, most: Column) -> Column:
    """The keys of segments of words of n letters that the token has within `most` places of their own."""
    def keys(i):
        start, size = _segment(n, most + 1, i)
        from_, to = F.greatest(start - most, F.lit(0)), F.least(start + most, F.length(token) - size)
        return F.when(to >= from_, F.transform(F.sequence(from_, to), lambda p: F.xxhash64(n, i, F.substr(token, p + 1, size)))).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), most), keys))


def _most(n: Column, bound: Bound) -> Column:
    """The most edits that any token may have from a word of n letters."""
    return F.greatest(*(F.when(n + d > 0, bound(n + d, n)).otherwise(0) for d in range(-APART, APART + 1))).cast("int")


def meetings(tokens: DataFrame, words: DataFrame, bound: Bound) -> DataFrame:
    """(token, word): pairs of tokens(token) and words(word) that may be near, each as often as it meets."""
    def by_deletions(n, most):
        return (n <= LETTERS) & (most <= DELETED)

    n = F.length("word")
    held = words.select("word").distinct().withColumns({"_n": n, "_most": _most(n, bound)})
    held = held.select("word", F.explode(F.when(by_deletions(F.col("_n"), F.col("_most")), deletions(F.col("word"), F.col("_most"))).otherwise(_segments(F.col("word"), F.col("_most")))).alias("key"))
    asked = tokens.select("token").distinct().withColumn("_n", F.length("token"))
    lengths = [F.col("_n") + d for d in range(-APART, APART + 1)]
    asked = asked.withColumns({f"_m{i}": _most(x, bound) for i, x in enumerate(lengths)})
    mosts = [F.col(f"_m{i}") for i in range(len(lengths))]
    deleted = F.greatest(*(F.when((x > 0) & by_deletions(x, m), m).otherwise(-1) for x, m in zip(lengths, mosts)))
    none = F.array().cast("array<bigint>")
    keys = [F.when(deleted >= 0, deletions(F.col("token"), deleted)).otherwise(none)]
    keys += [F.when((x > 0) & ~by_deletions(x, m), _segments_within(F.col("token"), x, m)).otherwise(none) for x, m in zip(lengths, mosts)]
    asked = asked.select("token", F.explode(F.array_distinct(F.concat(*keys))).alias("key"))
    return asked.join(held, "key").select("token", "word")


def near(tokens: DataFrame, words: DataFrame, bound: Bound) -> DataFrame:
    """(token, word, distance) for all pairs within bound(letters of the token, of the word) edits and APART in length, once each.

    The bound must not fall as either grows. Null words and tokens are near nothing."""
    t, w = F.length("token"), F.length("word")
    pairs = meetings(tokens.where("token <> ''"), words.where("word <> ''"), bound).where(F.abs(t - w) <= APART).distinct()
    return pairs.withColumn("distance", F.levenshtein("token", "word")).where(F.col("distance") <= bound(t, w))
