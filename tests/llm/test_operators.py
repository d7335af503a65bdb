import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import decontam, html_text, langid, sharding, topk, toxicity, warc


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, c in enumerate(text):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_search():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, n))) for n in (12, 30))
        edits, end = decontam.edit_search(a, b)
        assert edits == plain_distance(a, b)
        assert min(plain_distance_at(a, b, end)) == edits


def plain_distance_at(pattern, text, end):
    """Distances of pattern from the parts of text that stop at end."""
    return [whole(pattern, text[s:end]) for s in range(end + 1)]


def whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_decontamination(spark, documents):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(90, "ab"), (91, None), (92, ""), (93, "twelve letters on")]
    docs, want = [], set()
    for k in range(120):
        body = [word() for _ in range(150)]
        if k % 3 == 0:
            item, text = items[k % 20]
            chars = list(text)
            for _ in range(k % 7 * 3):
                chars[rnd.randrange(len(chars))] = rnd.choice("abc ")
            body[70:70] = "".join(chars).upper().split() if k % 2 else "".join(chars).split()
            want.add((k, item))
        docs.append((k, " ".join(body)))
    docs += [(500, "so twelve, LETTERS on!"), (501, None), (502, ""), (None, items[3][1]), (503, items[3][1]), (503, items[3][1])]
    want |= {(500, 93), (None, 3), (503, 3)}
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminations(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert len(got) == len(want) + 1
    assert decontam.uncontaminated(df, bench).count() == df.count() - len(got)
    assert decontam.contaminations(df, bench.limit(0)).count() == 0 and decontam.contaminations(df.limit(0), bench).count() == 0


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div class="cookie-banner">We use cookies</div>
    <div class="layout"><div class="post has-sidebar"><h2>Head &amp; line</h2><p>First   paragraph of the article, with <b>bold</b> text.<p>Second &eacute; paragraph<br>goes on for a while.
    <div></div>tail<ul><li>one item<li>two items</ul><form><input>Name</form><div id="comments"><p>nice post</p></div></div><div class="sidebar"><p>side</p></div></div><footer>&copy;</footer><script>var t="</p>";"""
    assert html_text.main_text(page) == "Head & line\nFirst paragraph of the article, with bold text.\nSecond é paragraph goes on for a while.\ntail\none item\ntwo items"
    for empty in (None, "", "<p>", "<script>x", "<nav>a</nav>"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text("only text < 5") == "only text < 5"
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert html_text.main_text(deep) == "deep text"


def test_warc_round_trip(spark):
    big = "x" * 1200
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (9, None, big), (3, "u\r\nX: y", "é" * 10), (4, "", None), (5, "u", ""), (6, "u", "é" * 10), (None, "n", big), (7, "u", "WARC/1.1\r\n\r\n" + big)]
    pages = spark.createDataFrame([(i, u, h, "d") for i, u, h in rows], "page_id long, url string, html string, payload_digest string")
    index = warc.archive(pages, 1000)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = next(h or "" for i, _, h in rows if i == r["page_id"]).encode()
        assert r["payload_bytes"] == len(payload)
        assert r["record_type"] == ("revisit" if r["page_id"] in (1, 2) else "response") or r["page_id"] is None
        assert r["refers_to"] == (9 if r["record_type"] == "revisit" else None)
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == payload
    some = warc.read_records(index.where("page_id in (3, 7)")).collect()
    assert {r["page_id"] for r in some} == {3, 7}
    assert warc.read_records(warc.archive(pages.limit(0))).count() == 0
    assert [x[:2] for x in warc.coalesced([(0, 5), (5, 5), (100_000, 1)])] == [(0, 10), (100_000, 100_001)]


def test_topk(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 40)).round(1)
    rows = [(i, [float(np.floor(256 * x)) for x in v]) for i, v in enumerate(m)]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (302, None), (303, [float("nan")] * 40), (304, [None] * 40), (305, [1.0, 2.0]), (350, [3.0, 4.0]), (306, []), (400, [1e18] * 40)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, query_block=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: v for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in whole if i % 50 == 0]:
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    assert set(got) == {i for i in whole if i % 50 == 0}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_minimax_is_the_smallest():
    rnd = random.Random(8)
    for _ in range(100):
        sizes, shards = np.array([rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 12))]), rnd.randrange(1, 6)
        best = [[None] * (shards + 1) for _ in range(len(sizes) + 1)]
        best[0] = [0] * (shards + 1)
        for i in range(1, len(sizes) + 1):
            for k in range(1, shards + 1):
                best[i][k] = min(max(best[j][k - 1], int(sizes[j:i].sum())) for j in range(i) if best[j][k - 1] is not None) if k else None
            best[i][0] = None
        capacity, cuts = sharding.minimax(sizes, shards)
        assert capacity == best[len(sizes)][shards]
        assert len(cuts) < shards and max(s.sum() for s in np.split(sizes, cuts)) == capacity


def test_sharding(spark, documents):
    for df, shards in ((documents, 3), (documents.limit(0), 3), (spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text")), 7)):
        rows = sharding.shard_by_bytes(df, shards, groups=64).collect()
        assert len(rows) == df.count()
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
        of_text = {}
        for r in rows:
            of_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        assert all(len(s) == 1 for s in of_text.values())


def test_language(spark, documents):
    rnd = random.Random(9)
    make = {"aa": "the of and ing tion er st".split(), "bb": "qu eau oi ment ré le des".split()}
    rows = [(i, "".join(rnd.choice(make[lang]) + (" " if rnd.random() < 0.3 else "") for _ in range(200)), lang) for i in range(100) for lang in make]
    learn = spark.createDataFrame([*rows, (1, None, "aa"), (2, "abc", None)], "doc_id long, text string, lang string")
    languages, prototypes = langid.learn(learn, F.col("doc_id") % 2 == 0)
    assert languages == ["aa", "bb"]
    got = langid.predict(learn.where("doc_id % 2 = 1 and text is not null and lang is not null"), languages, prototypes, into=("p", "s")).collect()
    assert all(r["p"] == r["lang"] and 0 <= r["s"] <= 1 for r in got)
    rows = langid.predict(documents, languages, prototypes).collect()
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {2, 3, 6, 7} and len(rows) == documents.count()
    assert langid.learn(learn.limit(0), F.lit(True))[0] == []
    assert {r["lang_pred"] for r in langid.predict(documents, [], np.zeros((0, langid.SIZE))).collect()} == {"und"}


def test_toxicity(spark, documents):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 8)))
    rows, labels = [], []
    for i in range(600):
        body = [word() for _ in range(rnd.randrange(5, 120))]
        if i % 4 == 0:
            for _ in range(2):  # as in the test tables, where toxic documents hold two or more
                body[rnd.randrange(len(body))] = rnd.choice(["zgrumpf", "bazwurk", "kvetchug"])
        rows.append((i, " ".join(body)))
        labels.append((i, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_labelled(docs, marks, F.col("doc_id") % 3 != 1)
    held = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).where("doc_id % 3 = 1").collect()}
    assert np.mean([held[i] >= 0.7 for i in held if i % 4 == 0]) > 0.8
    assert np.mean([held[i] >= 0.7 for i in held if i % 4]) < 0.1
    assert model.score("so " * 8 + "zgrumpfs") >= 0.7  # unseen, but its n-grams are known
    assert model.score("") == model.score(None) == 0
    got = toxicity.score(documents, model, into="s").collect()
    assert len(got) == documents.count() and all(0 <= r["s"] <= 1 for r in got)
    assert toxicity.fit_labelled(docs, marks.limit(0), F.lit(True)).score("zgrumpf") == pytest.approx(0, abs=1e-6)
