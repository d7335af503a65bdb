"""Exact top-k by inner product: columnar branch and bound.

Vectors lie dimension by dimension (vertical layout). Scores are accumulated one block of dimensions at a
time; after each block a candidate is dropped if its score so far plus the most that the remaining
dimensions can add, the product of both vectors' remaining lengths, stays under what the query's k-th
best has for certain. The survivors are compacted before the next block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block, and different candidates of a chunk, about: a block and a chunk meet in one group of one task.
QUERY_BLOCK, CHUNK = 2048, 16384
#: Candidates that are searched at once.
CANDIDATE_BLOCK = 4096


def _tail_norms(m: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """The lengths of m's columns from each cut on, rounded up."""
    squares = m * m
    return [np.sqrt(squares[c:].sum(axis=0)) * (1 + 1e-9) for c in cuts]


def branch_and_bound(queries: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray, query_ids: np.ndarray, row_ids: np.ndarray, block: int = 16, at_once: int = 64):
    """Yields (query, row indexes, scores): all rows that can be among the query's k best, with whole scores.

    queries and rows: dimensions x vectors, float64 with integer values, so that sums below 2**53 are exact.
    floor: scores that the k-th best of each query is known to reach; rows below it are not returned. Ties
    with the k-th best are returned. Rows with the query's own id take no part, so they never raise the bound.
    """
    d, n = rows.shape
    cuts = [*range(block, d, block)]
    row_tails, query_tails = _tail_norms(rows, cuts), _tail_norms(queries, cuts)
    for first in range(0, queries.shape[1], at_once):
        own = slice(first, first + at_once)
        q = queries[:, own]
        head = cuts[0] if cuts else d
        scores = q[:head].T @ rows[:head]  # the first block for all rows; no bound holds before it
        for i in range(q.shape[1]):
            s, least = scores[i], floor[first + i]
            own_id = row_ids == query_ids[first + i]
            alive = np.flatnonzero(~own_id) if own_id.any() else None
            s = s if alive is None else s[alive]
            for c, cut in enumerate(cuts):
                tails = row_tails[c] if alive is None else row_tails[c][alive]
                most = tails * query_tails[c][first + i]
                if len(s) > k:
                    least = max(least, np.partition(s - most, len(s) - k)[len(s) - k])
                keep = np.flatnonzero(s + most >= least - 1e-6 * max(1.0, abs(least)))
                alive = keep if alive is None else alive[keep]
                s = s[keep]
                if not len(alive):
                    break
                to = cuts[c + 1] if c + 1 < len(cuts) else d
                s = s + q[cut:to, i] @ rows[cut:to, alive]
            if alive is None:
                alive = np.arange(n)
            yield first + i, alive, s


class _Best:
    """The k best (score, row id) of every query so far, of rows with other ids than its own; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.best: list[list[tuple]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[keep], scores[keep]
        found = self.best[query] + [(-int(s), int(i)) for i, s in zip(ids.tolist(), scores.tolist())]
        self.best[query] = sorted(found)[: self.k]
        if len(self.best[query]) == self.k:
            self.floor[query] = -self.best[query][-1][0]


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors], np.float64).T


def _fits(a: float, b: float, d: int) -> bool:
    return a * b * max(d, 1) < 2**53


def top_k(rows: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, key, score long): for each query row the k other rows of highest inner product.

    vector: array of doubles with integer values. is_query: a condition on the rows. Rows whose vector is
    null or empty, or has a null or non-finite component, or whose key is null, take no part. Vectors of
    different lengths are not compared. The query's own key is left out; of repeated rows with one key each
    is a candidate of its own, and a repeated query has one result. Fewer than k rows give fewer results.
    Ties go to the smaller key. Scores beyond 2**53 are summed as whole numbers in Python, and held to the
    range of a long.

    Queries are dealt into blocks of about query_block, candidates into chunks, both by hash; every block is sent
    to every chunk by one shuffle, so no vector passes the driver. Equal rows are counted first and stand for k at
    most, which is all that a result can hold. Each group keeps k rows for each query, and these are ranked in one
    more shuffle.
    """
    v = F.col(vector)
    usable = rows.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"), is_query.alias("q")).where(
        "id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    )
    queries = usable.where("q").select("id", "v").dropDuplicates(["id"])
    asked, total = usable.agg(F.count_if("q"), F.count("*")).first()
    blocks, chunks = max(1, -(-asked // query_block)), max(1, -(-total // chunk))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    different = usable.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    candidates = different.select("id", "v", "n", F.pmod(F.xxhash64("id", "v"), F.lit(chunks)).alias("chunk"), numbers(blocks).alias("block"))
    queries = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), numbers(chunks).alias("chunk"))

    def search(own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, asked in own.groupby(own["v"].map(len)):
            found = pdf[pdf["v"].map(len) == d]
            if not len(found):
                continue
            q, best = _matrix(asked["v"]), _Best(asked["id"].to_numpy(np.int64), k)
            found = found.loc[found.index.repeat(found["n"])]
            for at in range(0, len(found), CANDIDATE_BLOCK):
                part = found.iloc[at : at + CANDIDATE_BLOCK]
                ids, m = part["id"].to_numpy(np.int64), _matrix(part["v"])
                if _fits(np.abs(m).max(), np.abs(q).max(), d):
                    for i, at_rows, scores in branch_and_bound(q, m, k, best.floor, best.ids, ids):
                        best.add(i, ids[at_rows], scores)
                else:
                    whole = [[int(x) for x in row] for row in m.T]
                    for i, query in enumerate(q.T):
                        query = [int(x) for x in query]
                        s = [max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(query, row)))) for row in whole]
                        best.best[i] = sorted(best.best[i] + [(-score, j) for j, score in zip(ids.tolist(), s) if j != best.ids[i]])[:k]
                        best.floor[i] = -np.inf
            out += [(int(query), i, -s) for query, held in zip(best.ids, best.best) for s, i in held]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    found = queries.groupBy("block", "chunk").cogroup(candidates.groupBy("block", "chunk")).applyInPandas(search, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
