"""Byte-level BPE encoding and decoding.

Each match of the split pattern is encoded alone. Pairs that can merge wait in a queue of one bucket
per merge rank; a bucket holds positions of a linked list of tokens, and a hierarchical bitmap over the
ranks finds the smallest rank by find-first-set. A position whose pair has changed since it was queued
is stale and skipped when it comes up. One queue serves all pre-tokens of a batch that are not known yet, so
that a bucket is emptied in a few array operations; a pre-token of any length takes its share of them, and
very long ones are no special case.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.shared import held

#: Encoded pre-tokens that a Python worker keeps, and the longest (in characters) that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 40
#: Characters of documents that are split at once.
SPLIT_CHARS = 2 << 20
#: Bytes of unknown pre-tokens that are merged at once (a longer pre-token is merged alone).
MERGE_BYTES = 1 << 20


class RankQueue:
    """Positions by merge rank; pop gives the smallest rank and all its positions, sorted."""

    def __init__(self, ranks: int):
        self.levels = []
        while True:
            ranks = (ranks + 63) // 64
            self.levels.append([0] * ranks)
            if ranks <= 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        else:
            cuts = [0, len(ranks)][: len(ranks) + 1]
        buckets = self.buckets
        for a, b, rank in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist() if len(ranks) else ()):
            if (bucket := buckets.get(rank)) is not None:
                bucket.append(positions[a:b])
                continue
            buckets[rank] = [positions[a:b]]
            for words in self.levels:
                was = words[rank >> 6]
                words[rank >> 6] = was | 1 << (rank & 63)
                if was:
                    break
                rank >>= 6

    def keep(self, rank: int) -> None:
        """The rank comes up again though no position is queued for it."""
        self.push(np.array([rank]), np.empty(1, np.int64))
        self.buckets[rank][-1] = np.empty(0, np.int64)

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.buckets:
            return None
        rank = 0
        for words in reversed(self.levels):
            word = words[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets.pop(rank)
        at = rank
        for words in self.levels:
            words[at >> 6] &= ~(1 << (at & 63))
            if words[at >> 6]:
                break
            at >>= 6
        if len(bucket) == 1:
            return rank, bucket[0]
        return rank, np.unique(np.concatenate(bucket))


class Codec:
    """Encodes and decodes by the ranks of one vocabulary; keeps the ids of short pre-tokens it has met."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        top = max(self.ranks.values()) + 1
        self.tokens = [b""] * top
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.queue = RankQueue(top)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)])
        # all pairs of tokens that make a token, as an open-addressing table: keys, then the made token
        pairs = [(a << 32 | b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        keys, made = np.array([p[0] for p in pairs] or [0], np.uint64), np.array([p[1] for p in pairs] or [0])
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys, self.made = np.full(slots, np.uint64(2**64 - 1)), np.full(slots, -1)
        left, self.probes = np.arange(len(pairs)), 0
        at = self._slot(keys)
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            self.keys[at[left[free]]] = keys[left[free]]
            self.made[at[left[free]]] = made[left[free]]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (slots - 1)
        # a token is early if it is part of a token of a smaller rank: merging it can bring that one up
        self.early = np.zeros(top, bool)
        for key, r in pairs:
            self.early[key >> 32] |= r < key >> 32
            self.early[key & 0xFFFFFFFF] |= r < key & 0xFFFFFFFF

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes, -1 if none."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._slot(keys)
        found = np.where(self.keys[at] == keys, self.made[at], -1)
        open_ = np.flatnonzero((found < 0) & (self.keys[at] != np.uint64(2**64 - 1)))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            hit = self.keys[at[open_]]
            found[open_] = np.where(hit == keys[open_], self.made[at[open_]], -1)
            open_ = open_[(hit != keys[open_]) & (hit != np.uint64(2**64 - 1))]
        return found

    def _one_a_piece(self, rank: int, at: np.ndarray, waiting: dict, of_piece: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Of every piece the leftmost place of an early rank: what its merge brings up comes before the next.

        The others wait, in a heap for each piece (sorted places are one as they are), and are not queued again: a place is
        put down and taken up once, however many there are. at: valid places, sorted; those that wait may have become stale."""
        heaps = waiting.pop(rank, None)
        own = of_piece[at]
        if heaps is None:
            if not len(at) or (first := np.append(True, own[1:] != own[:-1])).all():
                return at
            rest, own = at[~first], own[~first]
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(rest)]
            heaps = {int(own[a]): rest[a:b].tolist() for a, b in zip(cuts, cuts[1:])}
            chosen = at[first]
        else:
            for place, piece in zip(at.tolist(), own.tolist()):
                heappush(heaps.setdefault(piece, []), place)
            found = []
            for piece in list(heaps):
                heap = heaps[piece]
                while heap:
                    place = heappop(heap)
                    if pair[place] == rank:
                        found.append(place)
                        break
                if not heap:
                    del heaps[piece]
            chosen = np.array(sorted(found), np.int64)
        if heaps:
            waiting[rank] = heaps
            self.queue.keep(rank)
        return chosen

    def merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of every piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, ends = int(lengths.sum()), np.cumsum(lengths)
        token = np.append(self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)], -1).astype(np.int32)
        of_piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        # linked list: place n is the end of all pieces, with a token of no pair
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends[lengths > 0] - 1] = n
        before[(ends - lengths)[lengths > 0]] = n
        after[n] = before[n] = n
        # the rank of the pair that starts at each place, -1 if none
        pair = np.full(n + 1, -1, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        pair[inner] = self.rank_of(token[inner], token[after[inner]])
        start = inner[pair[inner] >= 0]
        queue = self.queue
        waiting: dict[int, dict[int, list[int]]] = {}
        queue.push(pair[start], start)
        while (least := queue.pop()) is not None:
            rank, at = least
            at = at[pair[at] == rank]  # the others are stale
            if self.early[rank]:
                at = self._one_a_piece(rank, at, waiting, of_piece, pair)
            if not len(at):
                continue
            if len(at) > 1 and not self.early[rank]:
                follows = after[at[:-1]] == at[1:]
                if follows.any():  # runs of one token, as in aaa: every other pair, from the left
                    first = np.append(True, ~follows)
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            gone = after[at]
            ahead = after[gone]
            token[at] = rank
            pair[gone] = -1
            after[at] = ahead
            before[ahead] = at
            before[n] = n
            behind = before[at]
            # pairs to both sides; at a piece's ends they are with place n, whose token makes none
            places = np.unique(np.concatenate([at, behind[behind < n]]))
            follow = after[places]
            made = np.where(follow < n, self.rank_of(token[places], token[follow]), -1)
            pair[places] = made
            pair[n] = -1
            good = made >= 0
            queue.push(made[good], places[good])
        alive = np.ones(n, bool)
        # a place is gone if its neighbour before does not lead to it
        back = before[:n]
        inner = np.flatnonzero(back < n)
        alive[inner] = after[back[inner]] == inner
        ids, owners = token[:n][alive], of_piece[alive]
        return np.split(ids, np.cumsum(np.bincount(owners, minlength=len(pieces)))[:-1])

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces; whole tokens are taken as they are."""
        out, todo, size = {}, [], 0
        ranks = self.ranks

        def flush():
            for piece, ids in zip(todo, self.merged([p.encode() for p in todo])):
                out[piece] = ids.astype("<u4").tobytes()

        for piece in pieces:
            data = piece.encode()
            if (whole := ranks.get(data)) is not None:
                out[piece] = whole.to_bytes(4, "little")
                continue
            if todo and size + len(data) > MERGE_BYTES:
                flush()
                todo, size = [], 0
            todo.append(piece)
            size += len(data)
        if todo:
            flush()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        split, known = self.split, self.known
        pieces = [split(x) if x else [] for x in texts]
        new: set[str] = set()
        for x in pieces:
            new.update(set(x).difference(known))
        learned = self.learn(list(new))
        if len(known) > CACHE_ENTRIES:
            used = set().union(*pieces)
            self.known = known = {k: v for k, v in known.items() if k in used}
        known.update(learned)
        out = [b"".join(map(known.__getitem__, x)) for x in pieces]
        for x in learned:
            if len(x) > CACHE_CHARS:
                del known[x]
        return out

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b""


def _codec(name: str, shared, pattern: str) -> Codec:
    """The codec of this Python worker, built once for many tasks."""
    return held(f"bpe {name} {pattern}", lambda: Codec(shared.value, pattern))


class ByteBPE:
    """Column functions over one vocabulary.

    path: a file of ranks, one "<base64 token> <rank>" a line, that the driver can read (under 10 MB; it is
    broadcast). encode(text) gives binary: the ids as little-endian unsigned 32-bit integers. decode(ids)
    gives binary: the text's bytes. round_trip(text) gives both in one pass over the rows: a struct of the ids and of
    the bytes decoded from these. Null or empty text: no ids; null or empty ids: no bytes. Ids outside the
    vocabulary are an error. Rows are independent, so repeated rows and ties need no rule; other columns
    of the table are not touched.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            vocabulary = f.read()
        if len(vocabulary) > 10_000_000:
            raise ValueError(f"{path}: {len(vocabulary)} bytes is too large to broadcast")
        shared = spark.sparkContext.broadcast(vocabulary)
        name = hashlib.sha1(vocabulary).hexdigest()

        def ids_of(codec: Codec, texts: list[str | None]) -> list[bytes]:
            # documents of so many characters at a time, so that the pre-tokens fit in memory
            cuts = np.flatnonzero(np.diff(np.cumsum([len(x or "") for x in texts]) // SPLIT_CHARS, prepend=0)).tolist()
            return [ids for a, b in zip([0, *cuts], [*cuts, len(texts)]) for ids in codec.encode(texts[a:b])]

        @F.pandas_udf("binary")
        def encode(texts: pd.Series) -> pd.Series:
            return pd.Series(ids_of(_codec(name, shared, pattern), texts.tolist()), dtype=object)

        @F.pandas_udf("binary")
        def decode(ids: pd.Series) -> pd.Series:
            codec = _codec(name, shared, pattern)
            return pd.Series([codec.decode(x) for x in ids], dtype=object)

        @F.pandas_udf("ids binary, decoded binary")
        def round_trip(texts: pd.Series) -> pd.DataFrame:
            codec = _codec(name, shared, pattern)
            ids = ids_of(codec, texts.tolist())
            return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([codec.decode(x) for x in ids], dtype=object)})

        self._encode, self._decode, self._round_trip = encode, decode, round_trip

    def encode(self, text: Column) -> Column:
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)

    def round_trip(self, text: Column) -> Column:
        return self._round_trip(text)


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
