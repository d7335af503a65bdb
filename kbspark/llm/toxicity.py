"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed into buckets that have an embedding each. The
embeddings of a window of SEGMENT words are averaged and go through a linear softmax; a misspelling shares most
n-grams with the word it stands for. A document scores as the highest of its windows, one from every word on:
over a whole document the average drowns the one word that makes it toxic (the README has held-out figures of both).
Labels are given for documents only, so training picks the segments that carry the label, again and again
(multiple-instance learning). Embeddings are kept where no bucket speaks against toxicity (projected steps): that
a text is clean is said by the bias, so common words around a toxic one, or a misspelt one, cannot outvote it.
Since averaging and the softmax's input are linear, scoring needs one number per bucket and adds these up by word.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.shared import held, unit_hash, unused, written

SEGMENT = 16
#: A segment of fewer n-grams is averaged as if it were filled up with words of zero vectors.
LEAST_GRAMS = 128
#: Labelled documents, and letters of them, that one task fits a model on, about; with more of them several models are averaged.
SHARD_DOCUMENTS, SHARD_LETTERS = 4000, 1 << 25
#: A fifth of the labelled documents, by a hash of the key, is for thresholds alone, if there are so many.
LEAST_HELD = 500
#: Weights are added up as whole multiples of 1 / FIXED, so that no order of adding matters; log odds are counted in steps of 1 / ODDS.
FIXED, ODDS = 1 << 24, 200
_EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»„“”‘’–—…¿¡·•"
CACHE_WORDS = 250_000
#: Words whose n-grams are hashed at once.
WORDS_AT_ONCE = 1 << 14


def buckets_of(word: str, mask: int, low: int = 3, high: int = 5) -> list[int]:
    """Buckets of a word's character n-grams, word ends marked, and of the word itself."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) & mask for g in grams] + [zlib.crc32(word.encode(), 7) & mask]


def _crc_table() -> np.ndarray:
    """What a byte does to a CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


_CRC = _crc_table()


def buckets_of_many(words: list[str], mask: int, low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owner): buckets_of all words, in the words' order, and each one's word. ASCII words are hashed together."""
    plain = [i for i, w in enumerate(words) if w.isascii()]
    ids, owner = [np.array([zlib.crc32(words[i].encode(), 7) & mask for i in plain], np.int64)], [np.array(plain, np.int64)]
    if plain:
        letters = np.frombuffer(("".join(f"<{words[i]}>" for i in plain) + "\0" * high).encode(), np.uint8)
        lengths = np.array([len(words[i]) + 2 for i in plain])
        word, left = np.repeat(plain, lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(lengths.sum())
        crc = np.full(len(word), 0xFFFFFFFF, np.uint32)
        for n in range(1, high + 1):
            crc = _CRC[(crc ^ letters[n - 1 : n - 1 + len(word)]) & 255] ^ (crc >> 8)
            if n >= low:
                whole = left >= n
                ids.append(((crc[whole] ^ np.uint32(0xFFFFFFFF)) & np.uint32(mask)).astype(np.int64))
                owner.append(word[whole])
    for i in set(range(len(words))).difference(plain):
        own = buckets_of(words[i], mask, low, high)
        ids.append(np.array(own, np.int64))
        owner.append(np.full(len(own), i))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], owner[order]


class Model(dict):
    """Scores texts. weights: the softmax's log odds that each bucket adds (before averaging); bias: those of no bucket.

    As a dictionary it keeps, by word as written, a place in two arrays: the word's summed weight and its
    number of n-grams (0 for bare punctuation)."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias
        self.sums, self.counts = np.zeros(1 << 16), np.zeros(1 << 16)

    def meet(self, words: list[str]) -> None:
        """Keeps words that it has not met."""
        first, n = len(self), len(words)
        while first + n > len(self.sums):
            self.sums, self.counts = np.append(self.sums, np.zeros(len(self.sums))), np.append(self.counts, np.zeros(len(self.counts)))
        bare = [w.strip(_EDGES) for w in words]
        ids, owner = buckets_of_many(bare, len(self.weights) - 1)
        self.sums[first : first + n] = np.bincount(owner, self.weights[ids], n)
        self.counts[first : first + n] = np.bincount(owner, minlength=n)
        none = first + np.flatnonzero([not w for w in bare])
        self.sums[none] = self.counts[none] = 0
        self.update(zip(words, range(first, first + n)))

    def odds(self, text: str | None) -> tuple[float, float]:
        """Log odds of the highest window of SEGMENT words, and of the whole text's average; -inf without words."""
        if len(self) > CACHE_WORDS:
            self.clear()
        raw = (text or "").lower().split()
        if new := [w for w in set(raw) if w not in self]:
            self.meet(new)
        place = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        place = place[self.counts[place] > 0]
        if not len(place):
            return -np.inf, -np.inf
        sums, counts = np.append(0, np.cumsum(self.sums[place])), np.append(0, np.cumsum(self.counts[place]))
        n = min(SEGMENT, len(place))
        highest = ((sums[n:] - sums[:-n]) / np.maximum(counts[n:] - counts[:-n], LEAST_GRAMS)).max()
        return highest + self.bias, sums[-1] / max(counts[-1], LEAST_GRAMS) + self.bias

    def score(self, text: str | None) -> float:
        """The probability of the most toxic window; 0 for a text without words."""
        return _probability(self.odds(text)[0])


def _probability(odds: float) -> float:
    return 1 / (1 + exp(-min(max(odds, -40), 40))) if odds > -np.inf else 0.0


def fit(texts: list[str], labels: list[int], buckets: int = 1 << 18, size: int = 8, rounds: int = 6, rate: float = 0.3, seed: int = 0, held: np.ndarray | None = None) -> Model:
    """Trains embeddings and softmax jointly on whole texts; deterministic. Without both labels: always 0.

    held: the texts that are not trained on, but for the threshold; by default every fifth of LEAST_HELD or more.
    The model's `seen` has the buckets that were met in training."""
    rng = np.random.default_rng(seed)
    # whole numbers in flat arrays: as Python lists they would take ten times the driver's memory
    vocabulary: dict[str, int] = {}
    flat_words, owner = array("i"), array("i")
    for d, text in enumerate(texts):
        n = 0
        for raw in (text or "").lower().split():
            if word := raw.strip(_EDGES):
                flat_words.append(vocabulary.setdefault(word, len(vocabulary)))
                n += 1
        flat_words.extend([-1] * (-n % SEGMENT))
        owner.extend([d] * -(-n // SEGMENT))
    words = list(vocabulary)
    del vocabulary
    parts = [(ids.astype(np.int32), np.bincount(own)) for at in range(0, len(words), WORDS_AT_ONCE) for ids, own in [buckets_of_many(words[at : at + WORDS_AT_ONCE], buckets - 1)]]
    flat, counts = (np.concatenate(x) for x in zip((np.zeros(0, np.int32), np.zeros(0, np.int64)), *parts))
    del words, parts
    y_doc = np.array(labels)
    if not len(owner) or len(set(labels)) < 2:
        return Model(np.zeros(buckets), -40.0)
    seg, owner = np.array(flat_words, np.int32).reshape(-1, SEGMENT), np.array(owner, np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    del flat_words
    y = y_doc[owner]
    e = rng.uniform(-1 / size, 1 / size, (buckets, size)).astype(np.float32)
    w, b = rng.normal(0, 0.3, (size, 2)).astype(np.float32), np.zeros(2, np.float32)
    ge, gw, gb = np.full(buckets, 1e-8, np.float32), np.full(w.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)

    def train(rows: np.ndarray, weight: np.ndarray) -> None:
        # few rows are gone through more often, and in smaller steps
        times, size_ = max(1, min(12, 12_000 // len(rows))) if not held.any() else 1, 256 if held.any() else 64
        order = np.concatenate([rng.permutation(len(rows)) for _ in range(times)])
        for at in range(0, len(order), size_):
            pick = order[at : at + size_]
            s, target, own = seg[rows[pick]], y[rows[pick]], weight[pick]
            words, place = np.unique(s, return_inverse=True)
            place = place.reshape(s.shape)
            if words[0] == -1:  # padding: a word of no n-grams
                words, place = words[1:], place - 1
            n = counts[words]
            firsts = np.cumsum(n) - n
            ids = flat[np.repeat(starts[words] - firsts, n) + np.arange(n.sum())]
            vectors = np.vstack([np.add.reduceat(e[ids], firsts, axis=0), np.zeros((1, size), np.float32)])
            total = np.maximum(np.append(n, 0)[place].sum(axis=1), LEAST_GRAMS).astype(np.float32)[:, None]
            h = vectors[place].sum(axis=1) / total
            z = h @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), target] -= 1
            p *= own[:, None]
            dh = (p @ w.T) / total
            dw, db = h.T @ p, p.sum(axis=0)
            dv = np.zeros_like(vectors)
            np.add.at(dv, place.ravel(), np.repeat(dh, SEGMENT, axis=0))
            step = np.repeat(dv[:-1], n, axis=0)
            np.add.at(ge, ids, (step * step).mean(axis=1))
            np.add.at(e, ids, -rate * step / np.sqrt(ge[ids])[:, None])
            gw[:] += dw * dw
            gb[:] += db * db
            w[:] -= rate * dw / np.sqrt(gw)
            b[:] -= rate * db / np.sqrt(gb)
            toward = w[:, 1] - w[:, 0]
            own_ids = np.unique(ids)
            against = np.minimum(e[own_ids] @ toward, 0) / max(float(toward @ toward), 1e-12)
            e[own_ids] -= against[:, None] * toward

    def odds() -> np.ndarray:
        own = e @ (w[:, 1] - w[:, 0])
        per_word = np.append(np.add.reduceat(own[flat], starts[:-1]), 0)
        return per_word[seg].sum(axis=1) / np.maximum(np.append(counts, 0)[seg].sum(axis=1), LEAST_GRAMS) + float(b[1] - b[0])

    if held is None:
        held = (np.arange(len(texts)) % 5 == 0) & (len(texts) >= LEAST_HELD)
    learn = ~held[owner]
    toxic, clean = np.flatnonzero((y == 1) & learn), np.flatnonzero((y == 0) & learn)
    rows = np.concatenate([toxic, rng.choice(clean, min(len(clean), 2 * len(toxic)), replace=False)])
    balanced = (y_doc == 0).sum() < 2 * y_doc.sum()  # else the highest segment of each clean document says enough
    train(rows, np.where(y[rows] == 1, 0.5, 0.5).astype(np.float32))
    # the windows of SEGMENT words that a document scores by: their first and last words, and where each document's begin
    flat_words, of_word = seg.ravel(), np.repeat(owner, SEGMENT)
    of_word, flat_words = of_word[flat_words >= 0], flat_words[flat_words >= 0]
    lengths = np.bincount(of_word, minlength=len(texts))
    begins = np.cumsum(lengths) - lengths
    windows = np.maximum(lengths - SEGMENT, 0) + (lengths > 0)
    first = np.repeat(begins, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    last = np.minimum(first + SEGMENT, np.repeat(begins + lengths, windows))
    grams = np.append(0, np.cumsum(counts[flat_words]))
    grams = np.maximum(grams[last] - grams[first], LEAST_GRAMS)

    def per_document() -> np.ndarray:
        """Every document's highest window, -inf without words."""
        sums = np.append(0, np.cumsum(np.add.reduceat((e @ (w[:, 1] - w[:, 0]))[flat], starts[:-1]).astype(np.float64)[flat_words]))
        z = (sums[last] - sums[first]) / grams + float(b[1] - b[0])
        out = np.full(len(texts), -np.inf)
        out[windows > 0] = np.maximum.reduceat(z, (np.cumsum(windows) - windows)[windows > 0])
        return out

    # of all rounds the model that does best on the documents held back; without any, the last
    best = (-np.inf, None, 0.0)
    for r in range(rounds + 1):
        z = odds()
        value, cut = _decision(per_document(), y_doc, held if held.any() else np.ones(len(texts), bool))
        if value >= best[0] or not held.any():
            best = (value, (e @ (w[:, 1] - w[:, 0])).astype(np.float64), float(b[1] - b[0]) - cut)
        if r == rounds:
            break
        by = np.lexsort((-z, owner))  # segments by document, the highest first
        rank = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
        top = by[rank == 0]
        chosen = by[learn[by] & ((rank == 0) | (rank < 4) & ((y[by] == 0) & balanced | (z[by] > 0)))]
        if r >= rounds - 2:  # a toxic label without any segment that looks it is taken for a wrong one
            hopeless = {int(d) for d, zz in zip(owner[top], z[top]) if y_doc[d] == 1 and zz < -1}
            chosen = chosen[~np.isin(owner[chosen], list(hopeless))]
        rows = np.concatenate([chosen, rng.choice(clean, min(len(clean), len(chosen)), replace=False)])
        share = max((y[rows] == 1).mean(), 1e-3)
        for _ in range(2):
            train(rows, np.where(y[rows] == 1, min(1.0, (1 - share) / share / 2), 1.0).astype(np.float32))
    model = Model(best[1], best[2] + log(0.7 / 0.3))
    model.seen = np.unique(flat)
    return model


def _decision(z: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """(value, log odds) of the cut that catches most toxic documents, a clean one caught counting three times in rate; each counts `times`."""
    own = (times > 0) & np.isfinite(z)
    by = np.argsort(z[own], kind="stable")
    z, y, times = z[own][by], y[own][by], times[own][by].astype(np.int64)
    toxic, clean = np.append(0, np.cumsum(times * (y == 1))), np.append(0, np.cumsum(times * (y == 0)))
    if not toxic[-1] or not clean[-1]:
        return -np.inf, 0.0
    cuts = np.unique(z)
    cuts = np.append(0.3 * cuts[1:] + 0.7 * cuts[:-1], cuts[-1] + 1)  # nearer to what is below: the odds of training are too sure
    below = np.searchsorted(z, cuts)
    value = (1 - toxic[below] / toxic[-1]) - 3 * (1 - clean[below] / clean[-1])
    at = int(value.argmax())
    return float(value[at]), float(cuts[at])


def fit_labelled(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """Fits on all labelled rows for which may_learn (a condition on the labels' key) holds.

    Null labels are left out; a document with several labels counts as toxic if one is; of repeated
    rows with one key the least text is learned from. Without labels the model scores 0.

    Up to SHARD_DOCUMENTS are fitted on at once. More are dealt out by a hash of the key, a task fits a model on each part, and the
    models are averaged: scores are linear in what a model has for each bucket, so this averages the models' log odds. A bucket counts in
    those parts that met it. If a label is so rare that parts would go without, its documents go to several. The threshold is then set
    for the averaged model, on the fifth that no part trained on. The driver gets one number for each bucket, and counts.
    """
    known = labels.where(may_learn & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(known.withColumnRenamed(key, "key"), "key").groupBy("key", "y").agg(F.min("text").alias("text"))
    rows = written(rows)
    totals = {r["y"]: r for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters")).collect()}
    shards = max(-(-sum(r["n"] for r in totals.values()) // SHARD_DOCUMENTS), -(-sum(r["letters"] or 0 for r in totals.values()) // SHARD_LETTERS))
    if shards <= 1 or len(totals) < 2:
        own = rows.toPandas().sort_values(["key", "text"]) if shards <= 1 else pd.DataFrame({"text": [], "y": []})
        return fit(own["text"].tolist(), own["y"].tolist())
    times = F.when(F.col("y") == 1, _copies(totals[1]["n"], shards)).otherwise(_copies(totals[0]["n"], shards))
    rows = rows.withColumn("held", unit_hash("key") < 0.2)
    parts = F.transform(F.sequence(F.lit(0), times - 1), lambda i: F.pmod(F.xxhash64("key", F.lit("part")) + i, F.lit(shards)).cast("int"))
    found = rows.withColumn("part", F.explode(parts)).repartitionById(shards, "part").mapInPandas(_fitted, "bucket int, value long")
    found = found.groupBy("bucket").agg(F.sum("value").alias("value"), F.count("*").alias("n")).toPandas()
    mean = dict(zip(found["bucket"].tolist(), (found["value"] / found["n"] / FIXED).tolist()))
    bias = mean.pop(-1, -40.0)
    weights = np.zeros(1 << 18)
    weights[list(mean)] = list(mean.values())
    model = Model(weights, bias)
    name, sent = _sent(rows.sparkSession, model)

    @F.pandas_udf("double")
    def odds(texts: pd.Series) -> pd.Series:
        own = _kept(name, sent)
        return pd.Series([own.odds(x)[0] for x in texts], dtype="float64")

    z = F.round(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), odds("text"))) * ODDS).cast("int")
    # texts without words are left out of the counts, not of the rows: a filter on odds would work them out twice
    counts = rows.where("held").select("y", z.alias("z")).groupBy("y", "z").count().toPandas()
    counts = counts[counts["z"] > -50 * ODDS]
    value, cut = _decision(counts["z"].to_numpy(np.float64) / ODDS, counts["y"].to_numpy(), counts["count"].to_numpy())
    return Model(weights, bias - cut + log(0.7 / 0.3)) if value > -np.inf else model


def _copies(documents: int, shards: int) -> int:
    """To how many parts each document of a label goes, so that each part has some 50 of the label."""
    return min(shards, max(1, -(-50 * shards // documents)))


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A model for each part: (bucket, weight in fixed point), the bias as bucket -1; nothing for a part without both labels."""
    for _, own in pd.concat([pd.DataFrame({"part": []}), *batches]).groupby("part"):
        own = own.sort_values(["key", "text"])
        y, held_back = own["y"].to_numpy(np.int64), own["held"].to_numpy(bool)
        if len(set(y[~held_back])) == 2:
            model = fit(own["text"].tolist(), y.tolist(), held=held_back)
            values = np.rint(np.append(model.weights[model.seen], model.bias) * FIXED).astype(np.int64)
            yield pd.DataFrame({"bucket": np.append(model.seen, -1).astype(np.int32), "value": values})


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score", average: str | None = None) -> DataFrame:
    """docs with the column `into`: 0 to 1, higher is likelier toxic; a column of that name is replaced.

    With `average` a second one: the same for the average over the whole text. Null and empty texts score 0. Every
    window of a text counts, whatever its length. Repeated rows score alike; an empty table gives an empty table.
    """
    name, sent = _sent(docs.sparkSession, model)

    @F.pandas_udf("highest double, average double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        own = _kept(name, sent)
        found = [own.odds(x) for x in texts]
        return pd.DataFrame([(_probability(a), _probability(b)) for a, b in found], columns=["highest", "average"], dtype="float64")

    own = unused(docs, "_scored")
    out = docs.withColumn(own, scored(F.col(text)))
    return out.withColumns({into: F.col(f"{own}.highest")} | ({average: F.col(f"{own}.average")} if average else {})).drop(own)


def _sent(spark: SparkSession, model: Model) -> tuple:
    """The model's name, and its broadcast: one number per bucket."""
    return hashlib.sha1(model.weights.tobytes() + str(model.bias).encode()).hexdigest(), spark.sparkContext.broadcast((model.weights, model.bias))


def _kept(name: str, sent) -> Model:
    """The model of this Python worker, with the words it has met."""
    return held(f"toxicity {name}", lambda: Model(*sent.value))
