"""A labelled key that is repeated over many rows brings one text to the driver."""

from pyspark.sql import functions as F

from kbspark.llm import toxicity


def test_one_text_a_key(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append((texts, y)))
    docs = spark.createDataFrame([(1, f"text {i:03}") for i in range(300)] + [(2, "other"), (3, None)], "doc_id long, text string")
    toxicity.fit_labelled(docs, spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, toxic int"), F.lit(True))
    assert seen == [(["text 000", "other", None], [1, 0, 0])]
