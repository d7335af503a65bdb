"""Models of language and toxicity are fitted on every labelled row, however many there are."""

import random

import numpy as np
from pyspark.sql import functions as F

from kbspark.llm import langid, toxicity
from kbspark.llm.shared import unit_hash


def test_every_text_of_a_language(spark):
    one = spark.createDataFrame([(1, "plain words", "aa")], "doc_id long, text string, lang string")
    many = spark.range(7001).select(F.col("id").alias("doc_id"), F.lit("plain words").alias("text"), F.lit("aa").alias("lang"))
    assert np.array_equal(langid.learn(many, F.lit(True))[1], 7001 * langid.learn(one, F.lit(True))[1])


def test_floors_are_of_all_texts(spark):
    """Most texts are in a language, but those that a hash of the key below a half picks are junk."""
    rnd = random.Random(6)
    text = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(60))
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(unit_hash("id") < 0.45, text("qxzjkvw")).otherwise(text("etaoinshrdl")).alias("text"), F.lit("aa").alias("lang"))
    learned = langid.learn(docs.where(unit_hash("doc_id") >= 0.45), F.lit(True))
    floor = max(langid.floors(docs, F.lit(True), *learned))
    assert abs(floor - langid.SHARE_OF_USUAL) < 1e-3


def test_every_labelled_text(spark):
    """A toxic word is learned that only documents have which a hash of the key would not pick."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 8)))
    late = {r["id"] for r in spark.range(9000).where(unit_hash("id") >= 0.5).collect()}
    rows = []
    for i in range(9000):
        toxic = i % 2
        told = [("bazwurk" if i in late and i % 10 == 1 else "zgrumpf")] if toxic else []
        rows.append((i, " ".join([word() for _ in range(8)] + told + [word() for _ in range(4)]), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_labelled(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    for bad in ("zgrumpf", "bazwurk"):
        assert np.mean([model.score(f"{word()} {word()} {bad} {word()} {word()} {word()}") >= 0.7 for _ in range(100)]) > 0.9
    assert np.mean([model.score(" ".join(word() for _ in range(30))) >= 0.7 for _ in range(100)]) < 0.1


def test_a_rare_label_reaches_every_part():
    assert toxicity._copies(10, 100) == 100
    assert toxicity._copies(1000, 100) == 5
    assert toxicity._copies(400_000, 100) == 1


def test_words_hashed_together():
    rnd = random.Random(7)
    words = ["", "a", "été", "日本語", "x" * 40] + ["".join(rnd.choice("abcé'-9") for _ in range(rnd.randrange(1, 12))) for _ in range(500)]
    ids, owner = toxicity.buckets_of_many(words, (1 << 18) - 1)
    for i, w in enumerate(words):
        assert sorted(ids[owner == i].tolist()) == sorted(toxicity.buckets_of(w, (1 << 18) - 1))
