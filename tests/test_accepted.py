"""accepted() with one hot key over many batches, against a plain fold; no group is held whole."""

import random
from datetime import datetime, timedelta

from kbspark.operators import integrity


def test_hot_key(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, None]), datetime(2026, 1, 1) + timedelta(seconds=i * 7 + rnd.randrange(7))) for i in range(3000)]
    want, state = {}, {}
    for i, user, ts in rows:
        count, last = state.get(user, (0, None))
        if last and (ts - last).total_seconds() >= 20:
            count = 0
        want[i] = count < 2
        state[user] = (count + 1, ts) if want[i] else (count, last)
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = integrity.accepted(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), ["user_id"], 20, 2)
        assert {r["event_id"]: r["accepted"] for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
