"""reuse_repair() against all pairs, and many entries of one keyword."""

import random
import time

from kbspark.operators import integrity as M


def _plain(orphans, entries):
    tokens = lambda p: {t.replace("*", "") for t in (p or "").lower().replace("|", " ").replace("&", " ").replace("+", " ").split()} - {""}
    out = {}
    for oid, keyword, pattern in orphans:
        found = []
        for eid, k, sub in entries:
            if keyword is not None and k is not None and keyword.lower() == k.lower():
                a, b = tokens(pattern), tokens(sub)
                found.append((-round(len(a & b) / len(a | b) + 1e-12, 2) if a | b else 0.0, eid))
        if found:
            found.sort()
            best, second = -found[0][0], -found[1][0] if len(found) > 1 else 0.0
            out[oid] = (found[0][1], best, best >= 0.6 and round(best - second, 2) >= 0.2)
    return out


def test_all_pairs(spark):
    r = random.Random(3)
    pattern = lambda: r.choice([None, "", "*", "|".join(r.choices("red* Blue old&rod cold bolt ring".split(), k=r.randint(1, 4)))])
    entries = [(i, r.choice(["K", "k", "m", "one", None]), pattern()) for i in range(60)] + [(90, "alone", "red&rod"), (91, "bare", None), (92, "bare", "*")]
    orphans = [(i, r.choice(["k", "M", "alone", "bare", "nowhere", None]), pattern()) for i in range(200)]
    got = M.reuse_repair(spark.createDataFrame(orphans, "id long, keyword string, pattern string"), spark.createDataFrame(entries, "id long, keyword string, sub_keyword string"))
    assert {x["orphan_id"]: (x["target_id"], x["similarity"], x["auto"]) for x in got.collect()} == _plain(orphans, entries)


def test_one_keyword(spark):
    entries = spark.range(60000).selectExpr("id", "'k' as keyword", "concat('w', id % 40, '&', 'v', id % 7) as sub_keyword")
    began = time.time()
    got = M.reuse_repair(entries.selectExpr("id", "keyword", "sub_keyword as pattern"), entries)
    assert got.where("target_id = orphan_id % 280 and similarity = 1 and not auto").count() == 60000
    assert time.time() - began < 60  # 3.6 billion pairs of entries
