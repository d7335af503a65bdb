"""Sharding by a minimax contiguous partition.

Rows are put in order by a hash of their text, so equal texts lie together, and the order is cut into a
fixed number of ranges of hashes: the atomic groups. Their sizes go to the driver (never more than
`groups` numbers, however large the table). Groups above the fair share of a shard come first in the order, the
largest first. The smallest feasible shard capacity is found by binary search, each capacity being checked
greedily, and the order is cut there. Where a large group alone sets the capacity, that leaves many ways to
cut the rest; it is cut by the smallest capacity again, so that the next largest shard is as small as can be, too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.shared import written

GROUPS = 1 << 16
#: Rows that one task numbers at once, but for small tables.
NUMBERED = 1 << 16


def greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Cuts (the first group of each next shard) if `shards` shards of that capacity hold all, else None.

    ends: running sums of the group sizes."""
    cuts, start, n = [], 0, len(ends)
    while True:
        base = int(ends[start - 1]) if start else 0
        stop = int(np.searchsorted(ends, base + capacity, "right"))
        if stop >= n:
            return cuts
        if stop == start or len(cuts) + 1 >= shards:
            return None
        cuts.append(stop)
        start = stop


def minimax(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which contiguous groups fit into the shards, and the cuts for it."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return 0, []
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, greedy(ends, low, shards)


def assign(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every group.

    A group above the fair share of what is left is the first in the order and sets the capacity alone: it gets a
    shard of its own, and minimax goes on with the rest, whose capacity is smaller.
    """
    out = np.full(len(sizes), -1, np.int64)
    left = np.flatnonzero(sizes > 0)
    next_shard = 0
    while next_shard < shards - 1 and len(left):
        fair = sizes[left].sum() / (shards - next_shard)
        large = left[sizes[left] > fair]
        if not len(large):
            break
        for g in large[np.argsort(-sizes[large], kind="stable")][: shards - 1 - next_shard]:
            out[g] = next_shard
            next_shard += 1
        left = np.setdiff1d(left, np.flatnonzero(out >= 0))
    if len(left):
        _, cuts = minimax(sizes[left], shards - next_shard)
        out[left] = next_shard + np.searchsorted(np.array(cuts, np.int64), np.arange(len(left)), "right")
    return np.where(out < 0, 0, out)


def shard_by_bytes(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", groups: int = GROUPS, overhead: int = 16) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row; slot counts from 0 without gaps in every shard.

    size: the text's UTF-8 bytes (null: none) plus `overhead`. Equal texts, null ones too, share a shard.
    The largest shard is as small as contiguous groups allow, but for groups above the fair share, which
    have a shard each. Repeated rows each have a slot, in any order among themselves; so do null keys. An
    empty table gives an empty table. With fewer groups than shards some shards stay empty.

    Slots: every group's first slot is known from the groups' row counts, and rows are numbered inside their
    group. Groups of many rows are dealt out into parts that are counted and numbered alone; a row's part comes from
    its place in the table, so that equal rows and equal or null keys are dealt out too.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + overhead).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("hash"),
        F.monotonically_increasing_id().alias("place"),
    )
    # ranges of the hash: its upper 31 bits, in `groups` equal parts; written once, so that a place is the same in all that follows
    slim = written(slim.withColumn("grp", F.floor(F.shiftrightunsigned("hash", 33) * groups / (1 << 31)).cast("int")))
    counts = slim.groupBy("grp").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toPandas().sort_values("grp")
    target = max(NUMBERED, int(counts["n"].sum()) // 4096)
    counts["parts"] = -(-counts["n"] // target)
    counts["shard"] = assign(counts["size"].to_numpy(np.int64), shards)

    parts = slim.join(F.broadcast(spark.createDataFrame(counts[["grp", "shard", "parts"]].astype("int64"), "grp long, shard long, parts long")), "grp")
    parts = parts.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("place"), F.col("parts"))).otherwise(F.lit(0)))
    dealt = counts[counts["parts"] > 1]["grp"].tolist()
    sized = [(int(g), 0, int(n)) for g, n, p in zip(counts["grp"], counts["n"], counts["parts"]) if p == 1]
    if dealt:
        sized += [(int(r[0]), int(r[1]), int(r[2])) for r in parts.where("parts > 1").groupBy("grp", "part").count().collect()]
    offsets = pd.DataFrame(sized, columns=["grp", "part", "n"], dtype="int64").merge(counts[["grp", "shard"]], on="grp").sort_values(["shard", "grp", "part"])
    offsets["first"] = offsets.groupby("shard")["n"].cumsum() - offsets["n"]
    offsets = spark.createDataFrame(offsets[["grp", "part", "first"]].astype("int64"), "grp long, part long, first long")
    order = Window.partitionBy("grp", "part").orderBy("hash", "key")
    numbered = parts.withColumn("at", F.row_number().over(order)).join(F.broadcast(offsets), ["grp", "part"])
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("at") - 1).alias("slot"))
