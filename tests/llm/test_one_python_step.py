"""Models are fitted with one Python step a plan: two in a row take two workers for each core, and do the work twice."""

import random

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from kbspark.llm import langid, toxicity


def test_one_python_step(spark, monkeypatch):
    plans, collected = [], DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collected(self))
    monkeypatch.setattr(toxicity, "SHARD_DOCUMENTS", 300)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 8)))
    rows = [(i, " ".join([word() for _ in range(12)] + ["zgrumpf"] * (i % 2)), i % 2, "aa") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    langid.floors(df, F.lit(True), *langid.learn(df, F.lit(True)))
    toxicity.fit_labelled(df, df.select("doc_id", "toxic"), F.lit(True))
    steps = [sum(p.count(x) for x in ("ArrowEvalPython", "MapInPandas")) for p in plans]
    assert steps == [1, 1, 1, 1]
