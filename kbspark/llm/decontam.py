"""Benchmark decontamination by the CGK embedding and bit-sampling LSH, verified by edit distance.

The CGK random walk reads a window: at step j it puts out the letter under its pointer and moves the pointer
on by a random bit that depends on j and the letter. Windows at a small edit distance fall into step again
after an edit, so their walks differ in few steps: edit distance has become Hamming distance. Walks are
compared by samples of their steps; several samples of several walks are taken, and a window that agrees
with a benchmark item's window in one sample is a candidate.

At EDITS a walk over a whole item of more than some letters falls out of step for good: over item-sized windows no
number of samples finds it (measured: the README). So windows are as long as the walk is likely to stay in step, and
start at each of the item's words; those that meet few edits say where it may lie. CLASSES sets their steps and
samples by the length of the item for the target recall, and how many windows have to hit at about the same distance
of the two starts. There the item's pieces of up to PIECE letters are compared side by side, and the whole item's
edit distance to the best part of the text decides.
Items under SHORT letters have too few windows. They are found where whole words of the text come within their edits,
those of one word, which any text may use, only where the text is no more than one word: both sides meet on what is left
of them without as many letters as they may have edits (deletion variants), and their edit distance decides.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.shared import held

#: Items with fewer letters than this are too short for windows: their words are looked up by deletion variants.
SHORT = 12
#: Letters of an item's piece, at most: a machine word; pieces that are compared side by side.
PIECE, SIDE_BY_SIDE = 64, 4096
#: A text is found if it is within this share of the item's length in edits.
EDITS = 0.2
#: Letters of benchmark items that are sent to the executors at once; a short item counts as ITEM_LETTERS, as its
#: variants and the hits of its runs take as much room.
BLOCK_LETTERS, ITEM_LETTERS = 4_000_000, 100
#: Window starts that walk together: their arrays fit a processor's cache.
TOGETHER = 1 << 15
#: Hits, candidates and variants that are held at once.
HELD = 1 << 20
_WORDS = re.compile(r"[^\W_]+")


def normalised(text: str | None) -> str:
    """Lower-cased letters and digits, all between them one space."""
    return " ".join(_WORDS.findall((text or "").lower()))


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and chr(i).isalnum():
            table[i] = 1 + i % 255
    return table


_tables: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    if not _tables:
        _tables.append(_letters())
    return _tables[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


class Class(NamedTuple):
    """How items of `least` letters or more are looked for: walks of `steps` steps, several samples of each that look at
    `sampled` of its steps, and how many windows have to hit at one place: one, and one more from each length in `more`.

    Every class finds at least TARGET_RECALL of its items at EDITS (tests/llm/test_decontam_recall.py measures it)."""

    least: int
    walks: int
    samples: int
    steps: int
    sampled: int
    more: tuple[int, ...] = ()
    exact: bool = False


TARGET_RECALL = 0.9
#: By length. Short items have few windows, so theirs are short, too: walks that move on at every step, from every
#: letter, are plain runs of letters. An edit touches as many runs as a run has letters; the others have to hit, at least
#: one (only at 15 letters may EDITS touch all).
CLASSES = (
    Class(SHORT, 1, 1, 4, 4, exact=True),
    Class(40, 2, 2, 12, 10, (65, 85)),
    Class(100, 2, 3, 20, 14, (100, 150, 200, 250, 300)),
)


class Walks:
    """The walks' random bits and the samples' steps, from a seed."""

    def __init__(self, kind: Class, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.kind = kind
        self.bits = rng.integers(0, 2, (kind.walks, kind.steps, 256), dtype=np.int32)
        if kind.exact:
            self.bits[:] = 1
        self.samples = [[np.isin(np.arange(kind.steps), rng.choice(kind.steps, kind.sampled, replace=False)) for _ in range(kind.samples)] for _ in range(kind.walks)]

    def starts(self, codes: np.ndarray, end: int) -> np.ndarray:
        """Where windows start: at every word, for plain runs at every letter."""
        codes = codes[:end]
        if self.kind.exact:
            return np.arange(len(codes))
        return np.flatnonzero((codes != 0) & np.append(True, codes[:-1] == 0)[: len(codes)])

    def hashes(self, codes: np.ndarray, starts: np.ndarray):
        """(repetition, hashes) for every sample; codes must go on for `steps` places after each start."""
        kind = self.kind
        for w in range(kind.walks):
            at = starts.astype(np.int32)
            found = [np.full(len(starts), np.uint64(1 + w * kind.samples + s)) for s in range(kind.samples)]
            for j in range(kind.steps):
                letter = codes[at]
                for s in range(kind.samples):
                    if self.samples[w][s][j]:
                        found[s] *= np.uint64(0x9E3779B97F4A7C15)
                        found[s] ^= letter
                at += self.bits[w, j][letter]
            for s in range(kind.samples):
                yield w * kind.samples + s, found[s] * np.uint64(0xD6E8FEB86659FD93)


class Tables:
    """The samples of the windows of one class of items, sorted by hash; item numbers are those of the index."""

    def __init__(self, kind: Class, codes: list[tuple[int, np.ndarray]], length: np.ndarray, slack: np.ndarray):
        self.walks, self.slack, self.tables = Walks(kind), slack, []
        hashes, item, offset = [[] for _ in range(kind.walks * kind.samples)], [], []
        for k, own in codes:
            starts = self.walks.starts(own, len(own))
            reads = kind.steps if kind.exact else kind.steps // 2 + 2
            starts = starts[(starts + reads <= len(own)) | (starts == 0)]  # what a walk mostly reads lies in the item
            item.append(np.full(len(starts), k))
            offset.append(starts)
            for r, h in self.walks.hashes(np.append(own, np.zeros(kind.steps, np.uint8)), starts):
                hashes[r].append(h)
        self.item, self.offset = np.concatenate(item), np.concatenate(offset)
        self.needed = 1 + np.searchsorted(kind.more, length, "right")
        if kind.exact:
            self.needed = np.maximum(1, length + 1 - kind.steps * (1 + (length * EDITS).astype(np.int64)))
        self.reach = int((length + 2 * slack)[np.unique(self.item)].max())  # the hits of one place lie within this
        for r in hashes:
            h = np.concatenate(r)
            order = np.argsort(h, kind="stable")
            bits = max(16, (8 * len(h)).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[h >> np.uint64(64 - bits)] = True
            self.tables.append((h[order], order, seen, np.uint64(64 - bits)))

    def places(self, codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, start) where enough windows of an item hit, some repeatedly; first: where each text's codes begin.

        TOGETHER starts at a time, fewer where these hit more than HELD times; a part's neighbours within reach are
        read with it, so that the hits of each place come together."""
        starts = self.walks.starts(codes, len(codes) - self.walks.kind.steps)
        parts = [(a, min(a + TOGETHER, len(starts))) for a in range(0, len(starts), TOGETHER)]
        while parts:
            a, b = parts.pop()
            low, high = np.searchsorted(starts, [starts[a] - self.reach, starts[b - 1] + self.reach + 1])
            hits = self._hits(codes, starts[low:high])
            if b - a > 1 and starts[b - 1] - starts[a] > self.reach and sum(int(many.sum()) for *_, many in hits) > HELD:
                parts += [(a, (a + b) // 2), ((a + b) // 2, b)]
            elif hits:
                yield self._enough(hits, first)

    def _hits(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(windows in a sample's order, starts, the first window's rank, the number of windows) of each sample that hits."""
        out = []
        for r, h in self.walks.hashes(codes, starts):
            sorted_, order, seen, shift = self.tables[r]
            hit = np.flatnonzero(seen[h >> shift])
            low, high = np.searchsorted(sorted_, h[hit], "left"), np.searchsorted(sorted_, h[hit], "right")
            if (high > low).any():
                out.append((order, starts[hit], low, high - low))
        return out

    def _enough(self, hits: list[tuple], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """places() of one part."""
        found = []
        for order, starts, low, many in hits:
            at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append(np.repeat(starts, many) * len(self.item) + order[at])
        pairs = np.sort(np.concatenate(found))
        place, window = np.divmod(pairs[np.append(True, pairs[1:] != pairs[:-1])], len(self.item))  # what several samples found counts once
        item = self.item[window]
        text = np.searchsorted(first, place, "right") - 1
        slack = self.slack[item]
        near = (place - self.offset[window] - first[text] + slack // 2) // slack
        keys = np.sort(((text * len(self.slack) + item) << 32) + near + (1 << 31))
        firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, hits = keys[firsts], np.diff(np.append(firsts, len(keys)))
        around = hits.copy()
        beside = np.flatnonzero(np.diff(keys) == 1)
        around[beside] += hits[beside + 1]
        around[beside + 1] += hits[beside]
        text, item = np.divmod(keys >> 32, len(self.slack))
        keep = around >= self.needed[item]
        start = ((keys[keep] & (1 << 32) - 1) - (1 << 31)) * self.slack[item[keep]]
        return text[keep], item[keep], start


def edit_search(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the part of text at the smallest edit distance from pattern; the first such end.

    Bit-parallel dynamic programming over whole-number bit vectors."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, distance, top, every = (1 << m) - 1, 0, m, 1 << m - 1, (1 << m) - 1
    best, end = m, 0
    for k, c in enumerate(text):
        eq = where.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(across | plus) & every, plus & across
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
            if distance < best:
                best, end = distance, k + 1
        up, down = up << 1 & every, down << 1 & every
        plus, minus = down | ~((eq | minus) | up) & every, up & (eq | minus)
    return best, end


def distance(a: str, b: str) -> int:
    """The edit distance of two short strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def without(text: str, most: int) -> Iterator[str]:
    """The text without any of its letters, up to `most` of them; some repeatedly."""
    for n in range(most + 1):
        for gone in combinations(range(len(text)), n):
            kept, at = "", 0
            for g in gone:
                kept, at = kept + text[at:g], g + 1
            yield kept + text[at:]


class Few:
    """Items of few letters by the hashes of their deletion variants, and the search for them in words of texts.

    Strings within some edits of each other have a variant in common without as many letters of either, so none is
    missed; the lookups of a text don't depend on the number of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        hashes, item = array("q"), array("q")
        self.deleted: dict[int, int] = {}  # by the length of a text's words: letters to leave out, where any item is near
        for k, (_, t) in enumerate(items):
            most = int(len(t) * EDITS)
            own = {hash(v) for v in without(t, most)}
            hashes.extend(own)
            item.extend([k] * len(own))
            for length in range(len(t) - most, len(t) + most + 1):
                self.deleted[length] = max(most, self.deleted.get(length, 0))
        hashes, item = np.array(hashes, np.int64), np.array(item, np.int64)
        order = np.argsort(hashes)
        self.hashes, self.item = hashes[order], item[order]

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of two or more words side by side that may be an item, of one where the text has no other."""
        ends = [m.end() for m in _WORDS.finditer(text)]
        begins, longest = [0, *(e + 1 for e in ends)], max(self.deleted, default=0)
        for a in range(len(ends)):
            for b in range(a + (len(ends) > 1), len(ends)):
                if ends[b] - begins[a] > longest:
                    break
                if ends[b] - begins[a] in self.deleted:
                    yield begins[a], ends[b]

    def near(self, spans: list[str]) -> dict[str, list[tuple[int, int]]]:
        """[(item id, edits)] of each of the spans that is near an item."""
        hashes, owner, out = array("q"), array("q"), {}
        for n, span in enumerate(spans):
            own = {hash(v) for v in without(span, self.deleted[len(span)])}
            hashes.extend(own)
            owner.extend([n] * len(own))
            if len(hashes) > HELD or n + 1 == len(spans):
                asked = np.array(hashes, np.int64)
                low, high = np.searchsorted(self.hashes, asked, "left"), np.searchsorted(self.hashes, asked, "right")
                for q in np.flatnonzero(high > low).tolist():
                    for k in self.item[low[q] : high[q]].tolist():
                        out.setdefault(owner[q], set()).add(k)
                hashes, owner = array("q"), array("q")
        near = {}
        for n, ks in out.items():
            for k in ks:
                i, t = self.items[k]
                if " " in spans[n] and " " not in t:
                    continue  # a single word is asked of texts of one word only
                if (edits := distance(t, spans[n])) <= int(len(t) * EDITS):
                    near.setdefault(spans[n], []).append((i, edits))
        return near

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, start, end, edits) of the closest words to each item in each text, the first of equally close ones."""
        if not self.items:
            return []
        near = self.near(sorted({t[a:b] for t in texts for a, b in self.spans(t)}))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, text in enumerate(texts) if near else ():
            for a, b in self.spans(text):
                for i, edits in near.get(text[a:b], ()):
                    best[n, i] = min(best.get((n, i), (edits, b, a)), (edits, b, a))
        return [(n, i, a, b, edits) for (n, i), (edits, b, a) in best.items()]


class Index:
    """The tables of a block of items, a class of lengths each, and the search for the items in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        every = [(i, t) for i, t in ((i, normalised(t)) for i, t in items) if t]
        self.few = Few([(i, t) for i, t in every if len(t) < SHORT])
        self.items = [(i, t) for i, t in every if len(t) >= SHORT]
        if not self.items:
            return
        codes = [_codes(t) for _, t in self.items]
        self.length = np.array([len(c) for c in codes])
        self.most = (self.length * EDITS).astype(np.int64)
        self.slack = np.maximum(4, self.most)
        self.tables = []
        for kind, beyond in zip(CLASSES, [*(c.least for c in CLASSES[1:]), np.inf]):
            own = [(k, c) for k, c in enumerate(codes) if kind.least <= len(c) < beyond]
            if own:
                self.tables.append(Tables(kind, own, self.length, self.slack))
        pieces = []
        for k, own in enumerate(codes):
            cuts = np.linspace(0, len(own), -(-len(own) // PIECE) + 1).astype(int)
            pieces += [(k, a, own[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.piece_of = np.searchsorted([k for k, _, _ in pieces], np.arange(len(self.items) + 1))
        self.piece_at = np.array([a for _, a, _ in pieces])
        self.piece_length = np.array([len(c) for _, _, c in pieces])
        self.piece_codes = np.zeros((len(pieces), PIECE), np.uint8)
        for row, (_, _, c) in zip(self.piece_codes, pieces):
            row[: len(c)] = c

    def candidates(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(text, item, start): where an item may lie, starts rounded so that near ones fall together.

        Enough windows of the item must have hits there, and its pieces must be found near by with no more
        edits in all than the item may have: nothing that is within EDITS fails the latter."""
        gap = np.zeros(max(c.steps for c in CLASSES), np.uint8)
        coded = [x for t in texts for x in (_codes(t), gap)]
        codes = np.concatenate([*coded, gap[:0]])
        first = np.cumsum([0] + [len(a) + len(b) for a, b in zip(coded[::2], coded[1::2])])
        pad = int(2 * self.slack.max() + PIECE + self.length.max()) + 1
        padded = np.concatenate([np.zeros(pad, np.uint8), codes, np.zeros(2 * pad, np.uint8)])
        for part in self._places(codes, first):
            text, item, start = np.unique(part, axis=1)
            keep = self._pieces_fit(padded, first[text] + start + pad, item)
            yield from np.stack([text[keep], item[keep], start[keep]]).T.tolist()

    def _places(self, codes: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """The places of all classes, about HELD at a time."""
        found, size, at, texts = [], 0, 0, len(first) - 1
        while at < texts:  # whole texts, so that a place's hits come together
            to = min(texts, max(at + 1, int(np.searchsorted(first, first[at] + TOGETHER * 4))))
            for tables in self.tables:
                for text, item, start in tables.places(codes[first[at] : first[to]], first[at : to + 1] - first[at]):
                    found.append(np.stack([text + at, item, start]))
                    size += len(text)
                    if size > HELD:
                        yield np.concatenate(found, axis=1)
                        found, size = [], 0
            at = to
        if size:
            yield np.concatenate(found, axis=1)

    def _pieces_fit(self, codes: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
        """For each place whether its item's pieces are found around it with at most the item's edits in all.

        edit_search for many pieces at once, each in one machine word; a place is given up at the first piece that
        brings it over. Pieces lie within one and a half times the slack of where the place has them: half of it from
        rounding, and the edits between the hit window and the piece."""
        counts = self.piece_of[item + 1] - self.piece_of[item]
        total = np.zeros(len(item), np.int64)
        left = np.arange(len(item))
        for nth in range(int(counts.max())):
            left = left[(counts[left] > nth) & (total[left] <= self.most[item[left]])]
            piece = self.piece_of[item[left]] + nth
            slack = self.slack[item[left]]
            around = slack + (slack + 1) // 2
            low, width = at[left] + self.piece_at[piece] - around, self.piece_length[piece] + 2 * around
            by = np.argsort(width, kind="stable")
            for a in range(0, len(by), SIDE_BY_SIDE):
                own = by[a : a + SIDE_BY_SIDE]
                total[left[own]] += self._closest(codes, np.maximum(low[own], 0), int(width[own].max()), piece[own])
        return total <= self.most[item]

    def _closest(self, codes: np.ndarray, low: np.ndarray, width: int, piece: np.ndarray) -> np.ndarray:
        """The fewest edits of each piece against any part of the `width` codes from its `low` on."""
        one = np.uint64(1)
        kinds, kind = np.unique(piece, return_inverse=True)
        where = np.zeros((len(kinds), 256), np.uint64)
        for j in range(PIECE):
            long = np.flatnonzero(self.piece_length[kinds] > j)
            where[long, self.piece_codes[kinds[long], j]] |= one << np.uint64(j)
        where, kind = where.ravel(), kind * 256
        m = self.piece_length[piece]
        top = (m - 1).astype(np.uint64)
        plus, minus = np.full(len(piece), ~np.uint64(0)), np.zeros(len(piece), np.uint64)
        distance, best = m.astype(np.int8), m.astype(np.int8)
        window = codes[np.minimum(low[None, :] + np.arange(width)[:, None], len(codes) - 1)]
        for letters in window:
            eq = where[kind + letters]
            across = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(across | plus), plus & across
            distance += ((up >> top) & one).astype(np.int8)
            distance -= ((down >> top) & one).astype(np.int8)
            np.minimum(best, distance, out=best)
            up, down = up << one, down << one
            across = eq | minus
            plus, minus = down | ~(across | up), up & across
        return best

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, start, end, edits) of the closest occurrence of each item in each text, in letters of the normalised text."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, k, start in self.candidates(texts) if self.items else ():
            pattern = self.items[k][1]
            most = int(len(pattern) * EDITS)
            held = best.get((text, k))
            if held and held[0] == 0:
                continue
            slack = max(4, most)
            low = max(0, start - 2 * slack)
            around = texts[text][low : max(0, start + len(pattern) + 2 * slack)]
            edits, end = edit_search(pattern, around)
            if edits <= most and (not held or (edits, low + end) < (held[0], held[2])):
                _, length = edit_search(pattern[::-1], around[:end][::-1])
                best[text, k] = (edits, low + end - length, low + end)
        found = [(text, self.items[k][0], start, end, edits) for (text, k), (edits, start, end) in best.items()]
        return sorted(found + self.few.search(texts))


def _index(name: str, items) -> Index:
    """The index of this Python worker, built once for many tasks."""
    return held(f"decontam {name}", lambda: Index(items.value))


def contaminations(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, start, end, edits): each benchmark item that a document's text holds, at its closest place.

    Texts are compared as lower-cased words of letters and digits; start and end count characters of that
    form. An item is held if some part of the text is within EDITS of the item's length in edits; one under
    SHORT characters if whole words of the text are, and one of a single word if the text is a word that is. Null or empty items are never found.
    Null and empty texts hold nothing, and items without an item_id are left out. Of equally near places of an
    item the one that ends first counts. Repeated rows of either table give repeated results, and so does a null
    key. Whole texts are searched, whatever their length; other columns of either table, of any name, play no part.
    An empty table of either kind gives an empty result. Benchmark items go to the executors in blocks of bounded
    size, each a pass over the documents.
    """
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = None
    for found_in in _blocks(docs.sparkSession, benchmark):
        found = slim.select("key", F.explode(found_in(F.col("text"))).alias("f")).select(F.col("key").alias(key), "f.*")
        out = found if out is None else out.unionByName(found)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text holds no benchmark item, as contaminations() finds them."""
    for found_in in _blocks(docs.sparkSession, benchmark):
        docs = docs.where(F.size(found_in(F.coalesce(F.col(text), F.lit("")))) == 0)
    return docs


def _blocks(spark: SparkSession, benchmark: DataFrame):
    """A column function for every block of items; one for none."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    letters = items.agg(F.sum(F.greatest(F.length("text"), F.lit(ITEM_LETTERS)))).first()[0] or 0
    blocks = max(1, -(-letters // BLOCK_LETTERS))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield _found(spark, sorted((r["item_id"], r["text"]) for r in block))


def _found(spark: SparkSession, items: list[tuple[int, str]]):
    sent = spark.sparkContext.broadcast(items)
    name = f"{zlib.crc32(repr(items).encode())}-{len(items)}"

    @F.pandas_udf("array<struct<item_id: long, start: int, end: int, edits: int>>")
    def found(texts: pd.Series) -> pd.Series:
        index = _index(name, sent)
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        if index.items or index.few.items:
            bodies = [normalised(x) for x in texts]
            at = 0
            while at < len(bodies):  # some 2 million letters at a time
                to, size = at, 0
                while to < len(bodies) and (to == at or size + len(bodies[to]) < 2_000_000):
                    size += len(bodies[to])
                    to += 1
                for k, item, start, end, edits in index.search(bodies[at:to]):
                    out[at + k].append({"item_id": item, "start": start, "end": end, "edits": edits})
                at = to
        return pd.Series(out, dtype=object)

    return found
