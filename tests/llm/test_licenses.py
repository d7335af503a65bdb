import random
import re

from kbspark.llm import licenses


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def plain(text, templates):
    w = words(text)
    have = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    out = {}
    for name, t in templates.items():
        tw = words(t)
        need = {" ".join(tw[i : i + 5]) for i in range(len(tw) - 4)}
        share = len(need & have) / len(need)
        if share >= licenses.CONTAINMENT:
            out[name] = round(share, 6)
    return out


def test_scan_against_brute_force(spark):
    rnd = random.Random(2)
    fill = lambda n: " ".join(rnd.choice("alpha beta gamma delta of the a license software copy".split()) + str(rnd.randrange(50)) for _ in range(n))
    texts = [None, "", "too short text", fill(30)]
    for name, t in licenses.TEMPLATES.items():
        for before in (0, 3, 17, 200):
            texts.append(f"{fill(before)} {t} {fill(rnd.randrange(30))}")
        w = t.split()
        for edits in (1, 2, 4):
            e = list(w)
            for _ in range(edits):
                e[rnd.randrange(len(e))] = "changed"
            texts.append(fill(11) + " " + " ".join(e))
        texts.append(t.upper().replace(" ", " -- "))
        texts.append(" ".join(w[: len(w) // 2]))
    texts += [texts[-2]] * 2 + [fill(30000) + " " + licenses.TEMPLATES["mit"]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = round(r["containment"], 6)
    for i, t in enumerate(texts):
        assert got.get(i, {}) == plain(t, licenses.TEMPLATES), (i, t)
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, {}).count() == 0
