"""Streams against their batch forms: over several micro-batches, a restart between them, late rows and batches that are run twice."""

import datetime as dt
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from kbspark.operators import integrity
from kbspark.streaming import events as W
from kbspark.streaming import limits, stored

BEGIN = dt.datetime(2024, 1, 1)


def new_folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def put(spark, rows, schema, folder):
    """One more file in a stream's source, younger than those before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def source(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


EVENTS = "event_id long, ip string, ts timestamp, spam boolean"


def some_events(n, seed=1, keys=6):
    rnd = random.Random(seed)
    at = BEGIN
    out = []
    for i in range(n):
        at += dt.timedelta(seconds=rnd.choice([0, 1, 5, 20, 90]))
        out.append((i, None if rnd.random() < 0.05 else f"k{rnd.randrange(keys)}", at, rnd.random() < 0.1))
    return out


@pytest.mark.parametrize("name", ["rate limit", "once", "throttle"])
def test_limits_over_a_restart(spark, name):
    rows = some_events(240)
    stream, batch = {
        "rate limit": (lambda e: limits.accepted_stream(e, ["ip"], 60, 3), lambda e: integrity.accepted(e, ["ip"], 60, 3)),
        "once": (lambda e: limits.accepted_stream(e, ["ip"], 300, 1), lambda e: integrity.accepted(e, ["ip"], 300, 1)),
        "throttle": (lambda e: limits.throttled_stream(e, ["ip"], 200, 4), lambda e: integrity.throttled(e, ["ip"], 200, 4)),
    }[name]
    folder, sink, checkpoint = new_folder(), new_folder(), new_folder()
    for part in (rows[:80], rows[80:160], rows[160:]):  # the stream is started anew for each
        put(spark, part, EVENTS, folder)
        W.run_available(stream(source(spark, EVENTS, folder)), sink, checkpoint)
    want = batch(spark.createDataFrame(rows, EVENTS))
    got = spark.read.parquet(sink)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_state_of_limits_expires(spark):
    folder, sink, checkpoint = new_folder(), new_folder(), new_folder()
    rows = [(i, f"k{i}", BEGIN, False) for i in range(50)]
    put(spark, rows, EVENTS, folder)
    W.run_available(limits.accepted_stream(source(spark, EVENTS, folder), ["ip"], 60, 1), sink, checkpoint)
    for day in (1, 2):
        put(spark, [(100 + day, "other", BEGIN + dt.timedelta(days=day), False)], EVENTS, folder)
        W.run_available(limits.accepted_stream(source(spark, EVENTS, folder), ["ip"], 60, 1), sink, checkpoint)
    held = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    assert held.count() <= 2  # of 51 keys those that the watermark has not passed
    assert spark.read.parquet(sink).count() == 52


VISITS = "ip_address string, created_at timestamp"


def test_visitors_stream(spark):
    rows = [(ip, ts) for _, ip, ts, _ in some_events(300, 4, 40)]
    folder, path, checkpoint = new_folder(), new_folder(), new_folder()
    for part in (rows[:100], rows[100:110], rows[110:]):
        put(spark, part, VISITS, folder)
        table = stored.visitors_stream(source(spark, VISITS, folder), path, checkpoint)
    want = W.visitors_upsert(spark.createDataFrame(rows, VISITS), spark.createDataFrame([], stored.VISITORS))
    key = lambda rows: sorted(map(str, rows))
    assert key(table.read().collect()) == key(want.collect())
    last = table.versions()[-1]
    table.merge(last, spark.createDataFrame(rows[110:], VISITS), lambda old, more: W.visitors_upsert(more, old))  # the last batch again
    assert key(table.read().collect()) == key(want.collect())


def test_compaction_and_empty_buckets(spark):
    table = stored.StoredTable(spark, new_folder(), "k long, n long", ["k"], buckets=4, compact=3)
    add = lambda old, more: old.unionByName(more).groupBy("k").agg(F.sum("n").alias("n"))
    for batch in range(7):
        table.merge(batch, spark.createDataFrame([(batch % 3, 1), (10, 1)], "k long, n long"), add)
    assert {tuple(r) for r in table.read().collect()} == {(0, 3), (1, 2), (2, 2), (10, 7)}
    assert table.versions() == [4, 5, 6]
    table.merge(7, spark.createDataFrame([(10, 0)], "k long, n long"), lambda old, more: old.join(more, "k", "left_anti"))
    assert {tuple(r) for r in table.read().collect()} == {(0, 3), (1, 2), (2, 2)}


QUEUED = "event_id long, content_type string, content_id long, ts timestamp, kind string"


def plain_queue(batches, most):
    queue, claims = {}, []
    for batch in batches:
        for _, kind_, id_, ts, kind in sorted(batch, key=lambda e: (e[3], e[0])):
            key = (kind_, id_)
            if kind == "success":
                queue.pop(key, None)
            elif kind in ("enqueue", "retry"):
                queue[key] = ["pending", 0, ts]
            else:
                n = min(3, queue.get(key, ["", 0])[1] + 1)
                queue[key] = ["failed" if n >= 3 else "pending", n, ts]
        for key in {(e[1], e[2]) for e in batch} & set(queue):
            queue[key][2] = max(e[3] for e in batch if (e[1], e[2]) == key)
        taken = sorted((k for k, v in queue.items() if v[0] in ("pending", "failed") and v[1] < 3), key=lambda k: (queue[k][2], k))[:most]
        claims.append(set(taken))
        for k in taken:
            queue[k][0], queue[k][2] = "processing", max(e[3] for e in batch)
    return queue, claims


def test_queue_stream(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["chunk", "kb_entry"]), rnd.randrange(25), BEGIN + dt.timedelta(seconds=i), rnd.choice(["enqueue", "failure", "failure", "success", "retry"])) for i in range(180)]
    batches = [rows[:70], rows[70:120], rows[120:]]
    folder, path, checkpoint = new_folder(), new_folder(), new_folder()
    for part in batches:
        put(spark, part, QUEUED, folder)
        queue, claims = stored.queue_stream(source(spark, QUEUED, folder), path, checkpoint, most=5)
    want, taken = plain_queue(batches, 5)
    assert {(r["content_type"], r["content_id"]): [r["status"], r["retry_count"], r["updated_at"]] for r in queue.read().collect()} == want
    assert [{(r["content_type"], r["content_id"]) for r in claims.read().where(F.col("batch") == b).collect()} for b in range(3)] == taken


LOG = "id long, created_at timestamp"
REJECTED = "question_id long, rejected_at timestamp"


def at(minutes):
    return BEGIN + dt.timedelta(minutes=minutes)


def test_late_rejections_as_a_stream(spark):
    """In time, just in time, too late, without; and after the watermark has passed, when the null side comes out."""
    log, rejections, sink, checkpoint = new_folder(), new_folder(), new_folder(), new_folder()
    run = lambda: W.run_available(W.late_rejections(source(spark, LOG, log), source(spark, REJECTED, rejections)), sink, checkpoint)
    seen = lambda: {r["id"]: r["ai_rejected"] for r in spark.read.schema("id long, ai_rejected int").parquet(sink).collect()}
    put(spark, [(1, at(0)), (2, at(1)), (3, at(2)), (4, at(3))], LOG, log)
    put(spark, [(1, at(5))], REJECTED, rejections)
    run()
    assert seen() == {1: 1}
    put(spark, [(2, at(61)), (3, at(63))], REJECTED, rejections)  # an hour after the question, and more than that
    run()
    assert seen() == {1: 1, 2: 1}
    put(spark, [(10, at(600))], LOG, log)
    put(spark, [(99, at(600))], REJECTED, rejections)
    run()
    put(spark, [(11, at(601)), (12, at(4))], LOG, log)  # 12 comes when the watermark has long passed it
    put(spark, [(4, at(4))], REJECTED, rejections)
    run()
    got = seen()
    assert {k: v for k, v in got.items() if k < 10} == {1: 1, 2: 1, 3: 0, 4: 0} and 12 not in got


def test_sessions_and_sliding_rates_as_streams(spark):
    schema = "id long, ip_address string, match_type string, created_at timestamp"
    rows = [(i, f"u{i % 3}", "none" if i % 4 == 0 else "exact", at(m)) for i, m in enumerate([0, 1, 2, 20, 25, 49, 52, 100, 101, 130, 131, 400, 401, 402])]
    last = [(99, "u0", "exact", at(60 * 24 * 30))]  # moves the watermark past all windows
    for make in (W.visitor_sessions, W.match_rate_sliding):
        folder, sink, checkpoint = new_folder(), new_folder(), new_folder()
        for part in (rows[:5], rows[5:9], rows[9:], last, [(98, "u9", "exact", at(60 * 24 * 30 + 1))], [(97, "u1", "exact", at(3))]):
            put(spark, part, schema, folder)
            W.run_available(make(source(spark, schema, folder)), sink, checkpoint)
        want = {str(r) for r in make(spark.createDataFrame(rows, schema)).collect()}
        got = [str(r) for r in spark.read.parquet(sink).collect()]
        assert want <= set(got) and len(got) == len(set(got))
        if make is W.visitor_sessions:
            assert set(got) == want  # the row that came too late is in no session
