"""Migration of legacy phrasings and pointers, the report on embeddings and the log without bots, on rows of every kind."""

from kbspark.operators import integrity as M
from kbspark.operators import matching as K
from kbspark.streaming.events import visitors_upsert

ENTRIES = "id long, keyword string, sub_keyword string, question string, reuse_response int"
LEGACY = "id long, keyword string, subkeyword string, rq string, reuse string, rkey string, rsubkey string"


def _tables(spark):
    entries = [
        (1, "fees", " AAdefault ", "What are fees", 0), (2, "fees", None, "x", 0), (3, "fees", "late", "When is it late", 0), (4, "fees", "one", None, None), (5, "fees", "none", "  Any fee?  ", 1),
        (6, "fees", "short", "no", 0), (7, "fees", "other", "How much", 0), (8, "fees", "had", "Had it", 0), (9, "Fees", "late", "Other case", 0),
    ]
    legacy = [
        (1, "fees", "late", "old one|older", "no", "", ""), (2, "fees", "late", " pay late |ab|pay late|after the day", "yes", "dates", None), (3, "fees", "one", "just one", "yes", "", "x"),
        (4, "fees", "none", None, "yes", "dates", "due"), (5, "fees", "short", "ab|c", "no", None, None), (6, "fees", "had", "has some|more", "yes", "dates", "due"), (7, "fees", " AAdefault ", "all of it", "yes", "dates", "due"),
    ]
    return spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(legacy, LEGACY), spark.createDataFrame([(8,), (8,)], "knowledge_id long")


def test_buckets(spark):
    got = {r["id"]: r for r in M.migration_buckets(*_tables(spark)).collect()}
    assert {i: r["bucket"] for i, r in got.items()} == {
        1: "aadefault", 2: "aadefault", 3: "matched_multi", 4: "matched_single", 5: "matched_no_var", 6: "no_question", 7: "unmatched", 8: "already_migrated", 9: "unmatched",
    }
    assert got[3]["variations"] == ["pay late", "after the day"]  # of two legacy rows the later
    assert got[5]["variations"] == ["Any fee?"] and got[1]["variations"] == [] and got[6]["variations"] == []
    assert {i: r["pointer"] for i, r in got.items() if r["pointer"]} == {3: "missing", 5: "set", 8: "missing"}


def test_apply(spark):
    buckets = M.migration_buckets(*_tables(spark))
    rows = sorted((r["knowledge_id"], r["sort_order"], r["variation_text"]) for r in M.apply_migration(buckets).collect())
    assert rows == [(3, 0, "pay late"), (3, 1, "after the day"), (4, 0, "just one"), (5, 0, "Any fee?"), (7, 0, "How much"), (9, 0, "Other case")]
    pointers = sorted(tuple(r) for r in M.missing_pointers(buckets).collect())
    assert pointers == [(3, 1, "dates", "aadefault"), (8, 1, "dates", "due")]
    stats = M.migration_stats(buckets).first().asDict()
    assert stats == {
        "total_rows": 9, "aadefault_skipped": 2, "already_migrated": 1, "matched_with_variations": 2, "matched_no_variations": 2, "unmatched_fallback": 2,
        "reuse_pointers_restored": 2, "variations_inserted": 6,
    }


def test_applied_twice_changes_nothing(spark):
    entries, legacy, had = _tables(spark)
    buckets = M.migration_buckets(entries, legacy, had)
    entries = entries.join(M.missing_pointers(buckets).selectExpr("id", "reuse_response as _set"), "id", "left").selectExpr("id", "keyword", "sub_keyword", "question", "coalesce(_set, reuse_response) as reuse_response")
    had = had.union(M.apply_migration(buckets).select("knowledge_id"))
    again = M.migration_buckets(entries, legacy, had)
    assert not M.apply_migration(again).count() and not M.missing_pointers(again).count()
    assert M.migration_stats(again).first()["already_migrated"] == 7


def test_restored(spark):
    entries, legacy, _ = _tables(spark)
    got = {r["id"]: (r["outcome"], r["reuse_keyword"], r["reuse_sub_keyword"]) for r in M.restore_reuse_pointers(entries, legacy).collect()}
    assert got == {
        3: ("restored", "dates", "aadefault"), 4: ("says_no", None, None), 5: ("already_set", None, None), 6: ("says_no", None, None), 7: ("no_match", None, None), 8: ("restored", "dates", "due"), 9: ("no_match", None, None),
    }


def test_empty_tables(spark):
    entries, legacy, had = (df.limit(0) for df in _tables(spark))
    buckets = M.migration_buckets(entries, legacy, had)
    assert not buckets.count() and not M.restore_reuse_pointers(entries, legacy).count()
    assert M.migration_stats(buckets).first()["variations_inserted"] == 0
    assert M.migration_buckets(_tables(spark)[0], legacy).where("bucket = 'unmatched'").count() == 5


def test_embedding_report(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "content_id long")
    vectors = [("kb_entry", 1, True), ("kb_entry", 1, True), ("kb_entry", 2, False), ("kb_entry", 9, True), ("chunk", 1, True), ("chunk", 8, True), ("other", 1, True)]
    vectors = spark.createDataFrame(vectors, "content_type string, content_id long, is_current boolean")
    queue = spark.createDataFrame([("pending",), ("pending",), ("failed",), ("done",), (None,)], "status string")
    got = {r["name"]: r["n"] for r in M.embedding_report(vectors, ids(1, 2, 3), ids(1, 2), queue).collect()}
    assert got == {"pending": 2, "processing": 0, "failed": 1, "total_kb_entries": 3, "total_chunks": 2, "embedded_kb_entries": 1, "embedded_chunks": 1, "stranded_rows": 2}


def test_log_without_bots(spark):
    asked = spark.createDataFrame([(1, "a", "u1", "Firefox", "2024-01-01"), (2, "b", "u1", "Googlebot", "2024-01-02"), (3, "c", "u2", None, "2024-01-03"), (4, "d", "u1", "Safari", "2024-01-04")], "id long, question string, ip_address string, user_agent string, t string")
    asked = asked.selectExpr("id", "question", "ip_address", "user_agent", "timestamp(t) as created_at")
    matches = spark.createDataFrame([(1, 7, 95, 1), (1, 8, 95, 2), (2, 7, 95, 1)], "id long, entry_id long, score int, place int")
    log = K.question_log(asked, matches)
    assert sorted((r["id"], r["entry_id"], r["match_type"]) for r in log.collect()) == [(1, 7, "exact"), (4, None, "none")]
    visits = visitors_upsert(log, spark.createDataFrame([], "ip_address string, visit_count long, first_visit timestamp, last_visit timestamp")).collect()
    assert [(r["ip_address"], r["visit_count"]) for r in visits] == [("u1", 2)]
