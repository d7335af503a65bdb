"""The pipeline's first stage against planted junk and clean texts, long and short."""

import os
import random

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_junk_goes_and_clean_texts_stay(spark):
    rnd = random.Random(12)
    kinds = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz    ", "".join(map(chr, range(0xE01, 0xE2E)))]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    junk = [(-1 - i, "".join(rnd.choice(kinds[i % 4]) for _ in range((500, 2000, 8000)[i % 3])), "en") for i in range(60)]
    short = [(-1000 - i, t, "en") for i, t in enumerate(("ok", "Hello there", "a1b2", "Merci beaucoup"))]
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.union(spark.createDataFrame(junk + short, docs.schema)), FOLDER).collect()}
    assert not kept & {i for i, _, _ in junk}
    assert {i for i, _, _ in short} <= kept
    clean = {r["doc_id"] for r in docs.where("text rlike '[a-zA-Z]'").collect()}
    assert len(clean - kept) <= len(clean) // 200
    print(len(clean - kept), "of", len(clean), "dropped")
