"""r10: texts are only taken apart for queries that have found nothing."""

from kbspark.operators import retrieval


def test_no_texts_for_no_queries(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, 1, "alpha betas"), (2, 1, "gamma call betas")], "chunk_id long, source_id long, content string")
    queries = spark.createDataFrame([(1, "alpha"), (2, "gamma")], "query_id long, query string")
    none = spark.createDataFrame([], "query_id long, chunk_id long, rank int")
    full = spark.createDataFrame([(1, 1, 2.0)], "query_id long, chunk_id long, relevance double")
    found = lambda queries: {tuple(x) for x in retrieval.find_relevant_chunks(chunks, queries, none, full).collect()}
    assert found(queries) == {(1, 1, "fulltext", 1), (1, 2, "contact", 1), (2, 2, "like", 1)}
    monkeypatch.setattr(retrieval, "like_fallback", lambda *a, **k: 1 / 0)
    assert found(queries.where("query_id = 1")) == {(1, 1, "fulltext", 1), (1, 2, "contact", 1)}
