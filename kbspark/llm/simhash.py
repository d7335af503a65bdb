"""SimHash near-duplicates: fingerprints, links at a small Hamming distance, and their components.

Links of two or fewer bits are found by deletion variants: a fingerprint is cut into two halves, of which
one differs by at most one bit, and every half is indexed under its 32 variants with one bit left out.
Equal variants are joined and verified. Only distinct fingerprints are indexed, so copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.shared import held, written

#: Fingerprints that share a variant are compared pair by pair up to this many; larger sets go by a second cut.
PAIRWISE = 24


def fingerprint_of(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, unsigned; 0 without words.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles keep their repeats and
    a text of fewer words is one shingle. A bit is 1 if set in over half of the shingles' XXH64.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = len(parts) - words + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp", words: int = 3, seed: int = 42) -> DataFrame:
    """docs with the column `into` (long, the fingerprint's 64 bits as a signed integer) in place of the text."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        held("simhash", dict)  # what other operators keep is let go
        return pd.Series(np.array([fingerprint_of(x, words, seed) for x in texts], np.uint64).view(np.int64))

    return docs.withColumn(into, fp(F.col(text))).drop(text)


def _halves(fp):
    return [(0, F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))), (1, fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32))]


def links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints that connect all at Hamming distance 1 or 2.

    Every pair returned is within two bits. Pairs that share a variant with few others are all returned;
    in sets of more than PAIRWISE only enough of them that whatever is linked stays connected. There,
    members with equal halves are indexed once more by their other half and its one-bit neighbours, keys
    whose holders are all within two bits of each other, and each is linked with the smallest of its key;
    one variant of a half does for that. Members that differ in the bit left out, and in one bit of the
    other half, are found by looking up the one-bit neighbours of the rarer kind among the other kind. So
    work and rows are in proportion to the members, not to their square.
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct().repartition(parts, "fp")  # few bytes now, 64 times as many rows next
    col = F.col("fp")
    variants = []
    for side, half, _ in _halves(col):
        for bit in range(32):
            # half without the bit, then the bit's number and the side: 31 + 5 + 1 bits
            low = half.bitwiseAND(F.lit((1 << bit) - 1))
            high = F.shiftleft(F.shiftrightunsigned(half, bit + 1), bit)
            variants.append(F.shiftleft(high.bitwiseOR(low), 6).bitwiseOR(F.lit(bit << 1 | side)))
    keyed = one.select("fp", F.explode(F.array(*variants)).alias("key"))
    # the size of each set comes from the one shuffle that brings it together; sets of one go at once
    many = written(keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    twos = many.where("n = 2").groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).select("a", "b").where(close)
    many = many.where("n > 2")
    few = many.where(F.col("n") <= PAIRWISE).select("key", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key").where("a < b").select("a", "b").where(close)
    side, bit = F.col("key").bitwiseAND(F.lit(1)), F.shiftrightunsigned(F.col("key").bitwiseAND(F.lit(63)), 1).cast("int")
    own = F.when(side == 0, F.shiftrightunsigned(col, 32)).otherwise(col.bitwiseAND(F.lit(0xFFFFFFFF)))
    rest = F.when(side == 0, col.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(col, 32))
    held = F.expr("shiftrightunsigned(own, bit) & 1L")
    big = many.where(F.col("n") > PAIRWISE).select("key", "fp", own.alias("own"), rest.alias("rest"), bit.alias("bit")).withColumn("held", held)
    equal = big.where("bit = 0").select("key", "fp", "held", F.explode(F.expr("transform(sequence(0, 32), j -> if(j = 32, rest, rest ^ shiftleft(1L, j)))")).alias("value"))
    least = equal.groupBy("key", "held", "value").agg(F.min("fp").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
    stars = equal.join(least, ["key", "held", "value"]).where("fp > a").select("a", F.col("fp").alias("b"))
    mixed = big.where("key & 1 = 0")
    kinds = mixed.groupBy("key").agg(F.sum("held").alias("ones"), F.count("*").alias("m")).where("ones > 0 and ones < m")
    mixed = mixed.join(kinds.select("key", (F.col("ones") * 2 <= F.col("m")).cast("long").alias("rare")), "key")
    asked = mixed.where("held = rare").select("key", F.col("fp").alias("a"), F.explode(F.expr("transform(sequence(0, 31), j -> rest ^ shiftleft(1L, j))")).alias("rest"))
    across = asked.join(mixed.where("held <> rare").select("key", "rest", F.col("fp").alias("b")), ["key", "rest"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = stars.union(across)
    return twos.union(pairs).union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge (a, b): the smallest id that it is connected to.

    Alternates large and small stars, each a grouping by node, until the edges no longer change; the edges
    of each round are written to the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    was = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b")
        large = large.distinct()
        low = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = large.withColumnRenamed("b", "n").join(low, "n").select(F.col("m").alias("a"), F.explode(F.array("n", "a")).alias("b")).where("a < b")
        edges = written(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for every row: component_id is the smallest key reachable over links.

    Texts that are null or have no word get fingerprint zero, which is linked like any other. Repeated rows
    stay repeated rows. A null key is returned with its component; it is never the smallest key unless all
    keys of a component are null. An empty table gives an empty table. Only the two columns are read.
    """
    fps = written(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))))
    ids = fps.groupBy("fp").agg(F.min("key").alias("low"))
    roots = components(links(ids))
    # components by fingerprint: the root with every member, then the smallest key of each
    named = ids.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(F.col("key").alias(key), "fp", "component_id")
