"""Language profiles against plain vectors, n-gram by n-gram; and rows of every kind."""

import random

import numpy as np
from pyspark.sql import functions as F

from kbspark.llm import langid


def plain_bundle(space, text):
    """The sum of the bound vectors of a text's trigrams, each made from its letters."""
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    symbols = [0, *(int(space.symbols[ord(c)]) for c in " ".join(clean.split())), 0]
    out = np.zeros(langid.SIZE)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        letters = [space.placed[langid.GRAM - 1][x] for x in (a, b, c)]  # not rotated
        out += np.roll(letters[0], 2) * np.roll(letters[1], 1) * letters[2]
    return out if clean.strip() else np.zeros(langid.SIZE)


def test_against_plain_vectors(spark):
    rnd = random.Random(17)
    words = {"aa": "the of and ing tion er st".split(), "bb": "qu eau oi ment ré le des".split(), "cc": "sch ung keit der die ß ver".split()}
    rows = [(i, " ".join("".join(rnd.choice(w) for _ in range(3)) for _ in range(rnd.randrange(1, 80))) + rnd.choice(["", "!  7", "\n"]), lang) for i in range(60) for lang, w in words.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, prototypes = langid.learn(df, F.col("doc_id") % 2 == 0)
    space = langid.Space()
    want = {lang: sum(plain_bundle(space, t) for i, t, g in rows if g == lang and i % 2 == 0) for lang in words}
    assert languages == sorted(words)
    assert np.array_equal(prototypes, np.array([want[lang] for lang in languages]))
    got = {(r["doc_id"], r["lang"]): r for r in langid.predict(df, languages, prototypes).collect()}
    for i, text, lang in rows:
        v = plain_bundle(space, text)
        cosines = [v @ p / np.linalg.norm(v) / np.linalg.norm(p) for p in prototypes]
        r = got[i, lang]
        assert abs(r["score"] - max(cosines)) < 1e-5
        assert r["lang_pred"] == languages[int(np.argmax(cosines))]


def test_blocks_do_not_matter(monkeypatch):
    rnd = random.Random(18)
    texts = ["".join(rnd.choice("abcdefghijklmnop éßñ") for _ in range(rnd.randrange(400))) for _ in range(300)] + ["", None]
    space = langid.Space()
    whole = [x for _, rows, n in space.in_blocks(texts) for x in zip(rows.tolist(), n.tolist())]
    monkeypatch.setattr(langid, "BLOCK_LETTERS", 500)
    monkeypatch.setattr(langid, "BLOCK_COUNTS", 700)
    assert [x for _, rows, n in langid.Space().in_blocks(texts) for x in zip(rows.tolist(), n.tolist())] == whole


def test_empty_table(spark, documents):
    assert langid.predict(documents.limit(0), ["x"], np.ones((1, langid.SIZE))).count() == 0
