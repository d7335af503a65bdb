"""Vector search by cosine: exact, and by inverted lists with an exact re-rank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that are multiplied with a block of queries at a time.
STEP = 1024


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def nearest(q: np.ndarray, ids: np.ndarray, m: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, key, similarity) of the k nearest rows of m to each of q, ties by key; similarities have 9 digits.

    Rows go by in steps. What is held are k candidates for each query and the products of one step, of which
    only those that reach a query's k-th so far, or tie with it, are rounded and sorted."""
    best_s, best_k = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0, keys.dtype)
    for a in range(0, len(m), STEP):
        s = q @ m[a : a + STEP].T
        if best_s.shape[1] == k:
            row, at = np.nonzero(s >= best_s[:, -1:] - 1e-9)  # rounding adds less
            if len(row):
                met, of = np.unique(row, return_inverse=True)
                n = np.bincount(of) + k
                of, s = np.concatenate([np.repeat(np.arange(len(met)), k), of]), np.concatenate([best_s[met].ravel(), np.round(s[row, at], 9)])
                own = np.concatenate([best_k[met].ravel(), keys[a + at]])
                order = np.lexsort((own, -s, of))[(np.cumsum(n) - n)[:, None] + np.arange(k)]
                best_s[met], best_k[met] = s[order], own[order]
            continue
        s = np.round(s, 9)
        own = np.broadcast_to(keys[a : a + STEP], s.shape)
        if s.shape[1] > k:
            # the k-th highest of a row; more than k may tie there, and then the keys decide
            floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            ties = (s >= floor[:, None]).sum(axis=1)
            width = int(ties.max())
            at = np.argpartition(-s, width - 1, axis=1)[:, :width] if width < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            s, own = np.take_along_axis(s, at, axis=1), np.take_along_axis(own, at, axis=1)
        s, own = np.hstack([best_s, s]), np.hstack([best_k, own])
        order = np.lexsort((own, -s), axis=1)[:, :k]
        best_s, best_k = np.take_along_axis(s, order, axis=1), np.take_along_axis(own, order, axis=1)
    return np.repeat(ids, best_k.shape[1]), best_k.ravel(), best_s.ravel()


def _search(k: int):
    def search(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "similarity": []}).astype({"query_id": "int64", "chunk_id": "int64"})
        ids, keys, s = nearest(_unit(asked["embedding"]), asked["query_id"].to_numpy(), _unit(rows["embedding"]), rows["chunk_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": ids, "chunk_id": keys, "similarity": s})

    return search


_FOUND = "query_id long, chunk_id long, similarity double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))).where(F.col("rank") <= k)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 2048, chunk: int = 16384) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): exact cosine, vectors(chunk_id, embedding), queries(query_id, embedding).

    Queries are dealt into blocks, vectors into chunks, by hash; a block and a chunk meet in one group, are multiplied there step by
    step, and k for each query go on to one more shuffle. No vector passes the driver or is exploded."""
    blocks, chunks = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // chunk))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    own = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), every(chunks).alias("chunk"))
    all_ = vectors.select("chunk_id", "embedding", F.pmod(F.xxhash64("chunk_id", "embedding"), F.lit(chunks)).alias("chunk"), every(blocks).alias("block"))
    found = own.groupBy("block", "chunk").cogroup(all_.groupBy("block", "chunk")).applyInPandas(_search(k), _FOUND)
    return _ranked(found, k)


def learn_lists(vectors: DataFrame, lists: int, sample: int = 50, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of inverted lists: spherical k-means on at most `sample` vectors a list, chosen by a hash of the vector alone.

    The sample is the only thing that passes the driver: lists * sample vectors."""
    picked = vectors.where("embedding is not null").select("embedding").orderBy(F.xxhash64("embedding", F.lit(seed))).limit(lists * sample).toPandas()
    m = _unit(picked["embedding"])
    rnd = np.random.default_rng(seed)
    centres = m[rnd.permutation(len(m))[:lists]]
    for _ in range(rounds):
        own = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)  # a centre without vectors stays
    return centres


def vector_lists(vectors: DataFrame, centres: np.ndarray, most: int = 1) -> DataFrame:
    """vectors(…, embedding) with `list`, once for each of the `most` nearest centres."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # as many rows as lists were asked for

    @F.pandas_udf("array<int>")
    def lists(rows: pd.Series) -> pd.Series:
        s = _unit(rows) @ shared.value.T
        n = min(most, s.shape[1])
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return vectors.where("embedding is not null").withColumn("list", F.explode(lists("embedding")))


def vector_ann(vectors: DataFrame, queries: DataFrame, k: int = 20, lists: int = 64, probes: int = 16, centres: np.ndarray | None = None, block: int = 2048, chunk: int = 16384) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): the k nearest among the vectors of the `probes` lists nearest to each query.

    Similarities are exact; what may be missed are vectors of other lists. With probes = lists nothing is. A list's
    vectors are dealt into chunks and its queries into blocks as in vector_topk(), so a list that holds a third of all is no one task's."""
    centres = learn_lists(vectors, lists) if centres is None else centres
    stored, asked = vector_lists(vectors.select("chunk_id", "embedding"), centres), vector_lists(queries.select("query_id", "embedding"), centres, probes)
    parts = stored.groupBy("list").agg(F.ceil(F.count("*") / chunk).alias("chunks")).join(asked.groupBy("list").agg(F.ceil(F.count("*") / block).alias("blocks")), "list")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    parts = F.broadcast(parts)  # a row for each list
    own = asked.join(parts, "list").select("query_id", "embedding", "list", F.pmod(F.xxhash64("query_id"), "blocks").alias("block"), every("chunks").alias("chunk"))
    all_ = stored.join(parts, "list").select("chunk_id", "embedding", "list", F.pmod(F.xxhash64("chunk_id", "embedding"), "chunks").alias("chunk"), every("blocks").alias("block"))
    found = own.groupBy("list", "block", "chunk").cogroup(all_.groupBy("list", "block", "chunk")).applyInPandas(_search(k), _FOUND)
    return _ranked(found, k)
