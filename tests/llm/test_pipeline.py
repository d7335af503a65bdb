"""The pipeline's decisions against plain Python, stage by stage, on a small table."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from kbspark.llm import decontam, simhash
from tests.llm.test_simhash import plain_components

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(now) <= set(kept)
        if name == "language_id":
            assert set(now) == {i for i, t in kept.items() if any(c.isalpha() for c in t or "")}
        if name == "near_duplicates":
            ids = sorted(kept)
            roots = plain_components([simhash.fingerprint_of(kept[i]) for i in ids])
            assert set(now) == {ids[r] for r in roots}
        if name == "decontamination":
            items = [decontam.normalised(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            clean = {i for i, t in kept.items() if all(decontam.edit_search(x, decontam.normalised(t))[0] > int(len(x) * decontam.EDITS) for x in items if len(x) >= decontam.SHORT)}
            assert set(now) == clean
        kept = now
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(kept)
    assert __spark_entry__.queries()["pipeline"](spark, FOLDER).count() == len(rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_columns_of_any_name(spark):
    """What the stages add for themselves never meets a column of the table, whatever its name and type."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ["_id", "_hash", "_guess", "_scored", "_kb_toxic", "_KB_LANG", "_kb_score", "_kb_size", "row", "fp", "component_id", "y", "place", "key"]
    more = docs.select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, more = (corpus_pipeline.written(stage(spark, x, FOLDER)) for x in (docs, more))
        rows = more.collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
        assert all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, more, FOLDER).count() == len(rows)


def test_empty_documents_and_no_labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
