"""A corpus pipeline of five stages over `documents`; part of subpackage llm.

Every stage gets what its predecessor kept, with the columns of `documents`, and keeps a part of it; the last
one returns token counts and digests. run() writes each stage's rows as Parquet in the shared folder and reads
them again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import decontam, queries, simhash
from kbspark.llm.shared import unused, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: those without any letter go, and those of some length that score as junk does."""
    return queries.in_a_language(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; the model is fitted on the labelled ones among docs."""
    score = unused(docs, "_kb_toxic")
    return queries.with_toxicity(spark, docs, sf_dir, docs, into=score).where(F.col(score) < 0.7).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, null last, then by the text's hash."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"))
    firsts = simhash.near_duplicates(docs.select(row.alias("row"), "text"), key="row").where("row <=> component_id")
    id_, hash_ = unused(docs, "_id"), unused(docs, "_hash")
    firsts = firsts.select(F.col("row.doc_id").alias(id_), F.col("row.hash").alias(hash_)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(hash_))
    return docs.join(firsts, same, "left_semi").dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return queries.encoded(spark, docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: SQL can express neither the models nor the fingerprints; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
