"""Fill-in-the-middle against plain Python, and back."""

import hashlib
import re

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from kbspark.llm import fill_middle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(key, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if key is None else key}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(lines)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b, c = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    return (n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < spm else (n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")


TEXTS = ["one\ntwo\nthree\n", "one line", "\n", "\n\n\n\n", "é\r\nñ\n漢字🙂\nlast", "<P> in it\nb", "ends in <\nS>\n<S", "a\n" * 50000, "", None, "x" * 300_000, "<\n>\nP\n<M\n"]


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (100, 100)])
def test_fill_and_restore(spark, rate, spm):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(150)] + [(None, "no\nkey\n"), (7, TEXTS[7]), (7, TEXTS[7])]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, made string, form int").repartition(3)
    made = df.select("doc_id", "text", fill_middle.fill_in_middle(F.col("text"), F.col("doc_id"), rate=rate, spm=spm).alias("own"))
    made = made.select("*", fill_middle.restore(F.col("own.output"), F.col("own.form")).alias("back"))
    got = made.collect()
    assert len(got) == len(rows)
    for r in got:
        own = r["own"]
        assert (own["n"], own["form"], own["prefix_chars"], own["middle_chars"], own["output"]) == plain(r["doc_id"], r["text"], rate, spm)
        assert own["output_sha256"] == sha(own["output"])
        assert r["back"]["text"] == (r["text"] or "") and r["back"]["text_sha256"] == sha(r["text"] or "")


def test_piece_table():
    text = memoryview(b"abcdef")
    table = fill_middle.PieceTable.of(text, 0, 6).cut(2, 2)
    assert [bytes(b[x:y]) for b, x, y in table.pieces] == [b"ab", b"", b"cdef"]
    for form, want in (("psm", b"<P>ab<S>cdef<M>"), ("spm", b"<S>cdef<P>ab<M>")):
        assert table.arranged(form).write() == want and table.arranged(form).restored(form).write() == b"abcdef"
        assert table.arranged(form).sha256() == hashlib.sha256(want).hexdigest()


def test_empty_table_nulls_and_broken_outputs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert empty.select(fill_middle.fill_in_middle(F.col("text"), F.col("doc_id"))).collect() == []
    df = spark.createDataFrame([(None, "psm"), ("x", None)], "o string, f string")
    assert all(r["text"] is None for r in df.select(fill_middle.restore(F.col("o"), F.col("f")).alias("b")).select("b.*").collect())
    with pytest.raises(PythonException):
        spark.createDataFrame([("<P>a<M>b", "psm")], "o string, f string").select(fill_middle.restore(F.col("o"), F.col("f"))).collect()
