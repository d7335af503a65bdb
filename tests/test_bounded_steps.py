"""Steps that were held whole, or done in vain."""

import pyarrow as pa

from kbspark.operators import indexing as I
from kbspark.plans import text as PT


def test_chunks_come_in_small_batches():
    text = "\n\n".join("word " * 100 for _ in range(40))
    n = 5 * I.CHUNKED_AT_ONCE
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text, None] * (n // 2))], names=["source_id", "text"])
    made = list(I._chunk_rows([batch]))
    assert len(made) == 5
    got = pa.Table.from_batches(made).to_pylist()
    assert [(r["source_id"], r["chunk_index"], r["content"]) for r in got] == [(i, k, c) for i in range(0, n, 2) for k, c in enumerate(I.chunks_of(text))]


def test_visits_need_no_matches(spark, monkeypatch):
    monkeypatch.setattr(PT, "matches", lambda *a, **k: 1 / 0)
    assert PT.QUERIES["k13_log_visitors"](spark, "/root/testdata/sf0.001").count()
