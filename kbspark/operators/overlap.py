"""Sets of words that share most with others: counted in blocks, without a row for every word that two of them share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words that a block of queries, or a part of the chunks, has together, about.
WORDS = 2_000_000

_FOUND = "query_id long, chunk_id long, score long"


def _codes(values, known) -> np.ndarray:
    """Places in known; -1 if not there."""
    return pc.fill_null(pc.index_in(values, value_set=known, skip_nulls=True), -1).to_numpy().astype(np.intp)


def _lists(table: pa.Table, name: str):
    """The values of a column of lists, one after the other, and where each list begins; the last number is their end."""
    column = table[name].combine_chunks()
    return pc.list_flatten(column), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])


def _search(most: int, bonus: int):
    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(asked) and len(held):
            queries, ids, n = asked["query_id"].to_numpy(), held["chunk_id"].to_numpy(), len(held)
            order = np.argsort(ids, kind="stable")
            ids, place = ids[order], np.argsort(order)
            (words, word_at), (kept, kept_at) = _lists(asked, "words"), _lists(held, "words")
            # which chunks have a word, the words one after the other
            known = pc.unique(words)
            code, chunk = _codes(kept, known), np.repeat(place, np.diff(kept_at))
            chunk, code = chunk[code >= 0], code[code >= 0]
            postings, ends = chunk[np.argsort(code, kind="stable")], np.cumsum(np.bincount(code, minlength=len(known)))
            starts, words = np.concatenate([[0], ends[:-1]])[: len(known)], _codes(words, known)
            sources = pc.unique(pc.drop_null(held["source_id"]))
            (near, near_at), (own, own_at) = _lists(asked, "sources"), _lists(asked, "own")
            near, own, source = _codes(near, sources), own.to_numpy(), _codes(held["source_id"], sources)[order]
            before = n - 1 - np.arange(n)
            for i, query in enumerate(queries):
                runs = [postings[starts[w] : ends[w]] for w in words[word_at[i] : word_at[i + 1]]]
                score = np.bincount(np.concatenate(runs), minlength=n) if runs else np.zeros(n, np.int64)
                points = np.zeros(len(sources) + 1, np.int64)
                points[near[near_at[i] : near_at[i + 1]]] = bonus
                points[-1] = 0  # a source that isn't known
                score += points[source]
                left_out = own[own_at[i] : own_at[i + 1]]
                for a, b in zip(np.searchsorted(ids, left_out), np.searchsorted(ids, left_out, "right"), strict=True):
                    score[a:b] = 0
                rank = score * n + before  # of equal scores the lower id first
                top = np.argpartition(rank, n - most)[n - most :] if n > most else np.arange(n)
                top = top[np.argsort(-rank[top])]
                top = top[score[top] > 0]
                out.append((np.full(len(top), query), ids[top], score[top]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "chunk_id", "score"])

    return search


def most_shared(held: DataFrame, asked: DataFrame, most: int, bonus: int = 0) -> DataFrame:
    """(query_id, chunk_id, score): for each query the `most` chunks with the highest scores over 0, ties by chunk_id.

    held(chunk_id, source_id, words), asked(query_id, words, sources, own): words are different ones. Score: words in both, and
    `bonus` in one of the query's sources; chunks of `own` don't count. Queries are dealt into blocks and chunks into parts, by hash, of
    WORDS words each; a block and a part meet in one group and are counted there query by query, and `most` of each go on to one more
    shuffle. Both are read twice, so they should be written. Every query meets every chunk, but costs a few nanoseconds a shared word."""
    parts, blocks = (max(1, -(-(df.agg(F.sum(F.size("words") + 1)).first()[0] or 0) // WORDS)) for df in (held, asked))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    own = asked.select("query_id", "words", "sources", "own", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), every(parts).alias("part"))
    all_ = held.select("chunk_id", "source_id", "words", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).alias("part"), every(blocks).alias("block"))
    found = own.groupBy("block", "part").cogroup(all_.groupBy("block", "part")).applyInArrow(_search(most, bonus), _FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
