"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound: the letters' vectors, permuted
(rotated) by their place in the n-gram, are multiplied component by component. A text's n-grams are bundled
(added up), a language's prototype is the bundle of its texts, and a text gets the language whose prototype
has the largest cosine with its own bundle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.shared import held, unused

#: Components of a vector; letters of an n-gram; different letters told apart (others share by code point).
SIZE, GRAM, LETTERS = 512, 3, 64
#: Letters that are bundled at once, and counts of n-grams by text that are held at once.
BLOCK_LETTERS, BLOCK_COUNTS = 1 << 20, 1 << 22
#: Languages that a block of texts is compared with at once.
BLOCK_LANGUAGES = 4096
#: A text of at least CLEAR different n-grams is in a language if its cosine is over this share of the usual one at its size.
CLEAR, SHARE_OF_USUAL = 64, 0.3
#: Steps of a score, from 0 to 1, that its median is told apart by.
STEPS = 10_000
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """Code point -> symbol: 0 for anything but letters, a-z apart from each other, all others by code point."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
            table[i] = i - 96 if 97 <= i <= 122 else 27 + i % (LETTERS - 27)
    return table


class Space:
    """Vectors of letters and n-grams; n-grams are bound when first met and kept, a byte a component.

    There are LETTERS ** GRAM n-grams, so what is kept is 134 MB at the very most."""

    def __init__(self, seed: int = 7):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, SIZE))
        self.placed = [np.roll(letters, GRAM - 1 - place, axis=1) for place in range(GRAM)]
        self.symbols = _letter_table()
        self.row = np.full(LETTERS**GRAM, -1, np.int32)
        self.bound, self.met = np.zeros((4096, SIZE), np.int8), 0

    def grams(self, text: str) -> np.ndarray:
        """The codes of a text's n-grams: letters lower-cased, everything between words one space."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        s = np.concatenate([[0], self.symbols[points], [0]]).astype(np.int32)
        s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]
        if len(s) < GRAM:
            return s[:0]
        return (s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The bound vectors of different n-grams."""
        fresh = codes[self.row[codes] < 0]
        if len(fresh):
            while self.met + len(fresh) > len(self.bound):
                self.bound = np.concatenate([self.bound, np.zeros_like(self.bound)])
            a, b, c = fresh // LETTERS**2, fresh // LETTERS % LETTERS, fresh % LETTERS
            self.bound[self.met : self.met + len(fresh)] = self.placed[0][a] * self.placed[1][b] * self.placed[2][c]
            self.row[fresh] = np.arange(self.met, self.met + len(fresh))
            self.met += len(fresh)
        return self.bound[self.row[codes]].astype(np.float32)

    def bundles(self, coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text's n-grams: its bundle, all zero if it has none; and how many different ones it has."""
        codes, owner = np.concatenate(coded), np.repeat(np.arange(len(coded)), [len(x) for x in coded])
        used, place = np.unique(codes, return_inverse=True)
        out, different = np.zeros((len(coded), SIZE), np.float32), np.zeros(len(coded), np.int64)
        if not len(used):
            return out, different
        # equal n-grams are added up before their vectors are, for a part of the n-grams at a time
        step = max(1, BLOCK_COUNTS // len(coded))
        for first in range(0, len(used), step):
            n = min(step, len(used) - first)
            own = (place >= first) & (place < first + n) if n < len(used) else slice(None)
            counts = np.bincount(owner[own] * n + place[own] - first, minlength=len(coded) * n).reshape(len(coded), n)
            out += counts.astype(np.float32) @ self.vectors(used[first : first + n])
            different += np.count_nonzero(counts, axis=1)
        return out, different

    def in_blocks(self, texts: list[str | None], block: int = 128):
        """(first, bundles, different n-grams) for blocks of texts, of few texts where they are long."""
        at = 0
        while at < len(texts):
            to, letters = at, 0
            while to < len(texts) and to - at < block and (to == at or letters + len(texts[to] or "") <= BLOCK_LETTERS):
                letters += len(texts[to] or "")
                to += 1
            yield at, *self.bundles([self.grams(x) if x else np.zeros(0, np.int32) for x in texts[at:to]])
            at = to


def _own_space() -> Space:
    return held("language", Space)


def learn(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes, from all rows for which may_learn holds and whose language is known.

    Rows without a letter teach nothing. Prototypes come to the driver: one vector of 4 KB for each language, of which the
    world has under ten thousand. Letters other than a-z share LETTERS - 27 symbols by code point, so the letters of
    one script are mostly told apart but those of two scripts can look alike.
    """
    rows = docs.where(may_learn & F.col(lang).isNotNull())

    def bundles(batches):
        sums: dict[str, np.ndarray] = {}
        space = _own_space()
        for pdf in batches:
            names = pdf["lang"].to_numpy()
            for at, rows, _ in space.in_blocks(pdf["text"].tolist()):
                own = names[at : at + len(rows)]
                for name in set(own):
                    sums[name] = sums.get(name, 0) + rows[own == name].sum(axis=0, dtype=np.float64)
        for name, v in sums.items():
            yield pd.DataFrame({"lang": name, "place": np.arange(SIZE), "value": np.rint(v).astype(np.int64)})

    parts = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInPandas(bundles, "lang string, place int, value long")
    total = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).toPandas()
    if not len(total):
        return [], np.zeros((0, SIZE))
    wide = total.pivot(index="lang", columns="place", values="value").sort_index()
    return list(wide.index), wide.to_numpy(np.float64)


def floors(docs: DataFrame, may_learn: Column, languages: list[str], prototypes: np.ndarray, text: str = "text", lang: str = "lang") -> list[float]:
    """The least score of a text in a language, by the bit length of its number of different n-grams.

    SHARE_OF_USUAL of the median score of the class among all the texts learned from, which junk among them hardly
    moves, and never less than in the class below. Texts under CLEAR n-grams have no floor: clean ones
    score as low as junk. Scores are counted in steps of 1 / STEPS, so few rows reach the driver whatever the table's size.
    """
    rows = docs.where(may_learn & F.col(lang).isNotNull()).select(F.col(text).alias("text"))
    scored = predict(rows, languages, prototypes, into=("p", "s"), size="n")
    # short texts are left out of the counts, not of the rows: a filter on what is predicted would predict twice, by twice the workers
    counts = scored.groupBy(_class("n").alias("c"), F.round(F.col("s") * STEPS).cast("int").alias("s"), (F.col("n") >= CLEAR).alias("clear")).count().toPandas()
    counts = counts[counts["clear"]].sort_values("s")
    usual = {c: own["s"].to_numpy()[np.searchsorted(own["count"].cumsum(), own["count"].sum() / 2)] / STEPS for c, own in counts.groupby("c")}
    out = [0.0] * 32
    for c, s in usual.items():
        out[c] = SHARE_OF_USUAL * float(s)
    for c in range(1, 32):
        out[c] = max(out[c], out[c - 1])  # clean texts score higher the longer they are: a class that is mostly junk does not
    return out


def in_a_language(score: str, size: str, floors: list[float]) -> Column:
    """Whether a text's score reaches the floor of its size."""
    return F.col(score) >= F.element_at(F.array(*map(F.lit, floors)), _class(size) + 1)


def _class(size: str) -> Column:
    return F.length(F.bin(F.col(size).cast("long")))


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, text: str = "text", into: tuple[str, str] = ("lang_pred", "score"), size: str | None = None) -> DataFrame:
    """docs with two columns more: the predicted language and its score (the cosine, 0 to 1).

    With `size` a third: how many different n-grams the text has.

    Texts that are null or have no letter, or all if no language was learned, get `und` and score 0. Ties go
    to the first language in order. Repeated rows are predicted alike; no other column is looked at, and an
    empty table gives an empty table; a column that has one of the given names is replaced, any other stays. Whole texts are
    read: memory grows with the longest of them.
    """
    lengths = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = (prototypes / np.where(lengths == 0, 1, lengths)).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((languages, unit))

    @F.pandas_udf("lang_pred string, score double, size int")
    def guess(texts: pd.Series) -> pd.DataFrame:
        languages, unit = sent.value
        names, scores, sizes = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        for at, rows, different in _own_space().in_blocks(texts.tolist()) if languages else ():
            lengths = np.linalg.norm(rows, axis=1)
            best, cosine = np.zeros(len(rows), np.int64), np.full(len(rows), -np.inf)
            for first in range(0, len(unit), BLOCK_LANGUAGES):
                own = rows @ unit[first : first + BLOCK_LANGUAGES].T / np.maximum(lengths, 1e-9)[:, None]
                top = own.argmax(axis=1)
                value = own[np.arange(len(rows)), top]
                best, cosine = np.where(value > cosine, first + top, best), np.maximum(cosine, value)
            known = np.flatnonzero(lengths > 0)
            names[at + known] = np.array(languages, object)[best[known]]
            scores[at + known] = np.clip(cosine[known], 0, 1)
            sizes[at : at + len(rows)] = different
        return pd.DataFrame({"lang_pred": names, "score": scores, "size": sizes})

    own = unused(docs, "_guess")
    found = {into[0]: F.col(f"{own}.lang_pred"), into[1]: F.col(f"{own}.score")} | ({size: F.col(f"{own}.size")} if size else {})
    return docs.withColumn(own, guess(F.col(text))).withColumns(found).drop(own)
