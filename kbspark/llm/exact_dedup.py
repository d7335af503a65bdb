"""Exact deduplication by a tree merge of sorted digest runs, with DataFrame functions alone.

Every partition of the table is a run: its rows as (digest, SHA-256, smallest identifier, count), one for each text.
Runs merge in rounds as the nodes of a binomial tree do. In a round each run goes to the run whose number has the
lowest bits cleared; `ways` runs (a power of two, so several binomial rounds at once) become one, sorted by digest,
and texts that several of them hold become one entry. When run 0 alone is left it has every text once. The
results go back down the same tree, from each run to those that it was merged from, and at last to the rows.

No key is hot anywhere: a text that a third of all rows share is one entry in each run, so a merge meets
`ways` of them at most, and the way down hands each entry to `ways` others. The last run is one in name only; its entries are
spread over the tasks by digest. Every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.shared import written

#: Runs that one round merges into one: three binomial rounds at once.
WAYS = 8


def merged(runs: DataFrame, bits: int) -> DataFrame:
    """The next round of runs(run, digest, sha, first, n): `2 ** bits` of them become one.

    Entries are one only if the digest and the SHA-256 behind it agree, so a smallest identifier is always
    that of rows with this very text."""
    return runs.groupBy(F.shiftright("run", bits).alias("run"), "digest", "sha").agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def handed_down(runs: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """runs with `first` and `n` of the run above that each was merged into."""
    above = above.select(F.col("run").alias("_above"), "digest", "sha", "first", "n")
    return runs.drop("first", "n").withColumn("_above", F.shiftright("run", bits)).join(above, ["_above", "digest", "sha"]).drop("_above")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", ways: int = WAYS) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal when identical after every run of ASCII white space has become one space; null counts as empty, and so
    null and empty texts are one group. Of equal texts the row with the smallest key stays (null keys last); of several
    with that key just one does, whichever. keep_id is null where no row of the group has a key. group_size counts rows,
    repeated ones too. An empty table gives an empty table. Other columns are not read, whatever their names.
    `ways`: a power of two.
    """
    bits = ways.bit_length() - 1
    if ways < 2 or ways != 1 << bits:
        raise ValueError("ways must be a power of two, 2 or more")
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(F.col(key).alias("key"), body.alias("body"))
    # written once, so that a row's run and place are the same in all that follows
    rows = written(rows.select("key", F.xxhash64("body").alias("digest"), F.unhex(F.sha2("body", 256)).alias("sha"), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("place")))

    row = F.struct(F.col("key").isNull().alias("unnamed"), "key", "place")
    left = rows.agg(F.coalesce(F.max("run"), F.lit(0)).alias("last")).first()["last"]
    rounds = [written(merged(rows.select("run", "digest", "sha", row.alias("first"), F.lit(1).cast("long").alias("n")), bits))]
    while left := left >> bits:
        rounds.append(written(merged(rounds[-1], bits)))
    found = rounds.pop()
    while rounds:
        found = written(handed_down(rounds.pop(), found, bits))
    out = handed_down(rows, found, bits)
    return out.select(F.col("key").alias(key), F.col("first.key").alias("keep_id"), F.col("n").alias("group_size"), (F.col("first.place") == F.col("place")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
