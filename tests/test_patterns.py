"""The pattern compiler's last steps against plain code, on the parts' phrasings and on small cases."""

import os
from itertools import groupby

import pytest

from kbspark.operators import patterns as P
from kbspark.plans import compiler

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_joined_pattern():
    assert P.joined_pattern(["red*", "blue*&lamp*", "red*", "lamp*"]) == "lamp*|red*"
    assert P.joined_pattern(["product*", "production*", "apple*"]) == "apple*|product"
    assert P.joined_pattern(["a*&b*", "a*&c*&b*"]) == "a*&b*"
    assert P.joined_pattern([]) == ""


def by_entry(rows):
    rows = sorted(rows, key=lambda r: (r["keyword"], r["entry_id"], r["no"], r["idx"]))
    for entry, own in groupby(rows, key=lambda r: (r["keyword"], r["entry_id"])):
        yield entry, [[r["stem"] for r in v] for _, v in groupby(own, key=lambda r: r["no"])]


def plain_phrases(variations):
    found = []
    for n in (3, 2):
        runs = [{" ".join(v[i : i + n]) for i in range(len(v) - n + 1) if all(len(w) >= 2 for w in v[i : i + n])} for v in variations]
        for phrase in set().union(*runs):
            count = sum(phrase in r for r in runs)
            share = count / len(variations)
            if len(variations) == 1 or (share >= 0.75 if n == 3 else count >= 2 and share >= 0.5):
                found.append((-share, -n, phrase))
    taken, out = set(), []
    for _, _, phrase in sorted(found):
        if not taken & set(phrase.split()):
            taken |= set(phrase.split())
            out.append(phrase)
    return out


@needs_tables
def test_phrases(spark):
    want = {e: "|".join(plain_phrases(v)) for e, v in by_entry(compiler._tokens(spark, FOLDER).collect())}
    got = {(r["keyword"], r["entry_id"]): r["phrases"] for r in compiler.QUERIES["p8_detect_phrases"](spark, FOLDER).collect()}
    assert got == {e: p for e, p in want.items() if p} and got


@needs_tables
def test_patterns_and_tiers(spark):
    scored = compiler._scored(spark, FOLDER).collect()
    anchors = P.shared_anchors(compiler._tokens(spark, FOLDER))
    picked = sorted(P.discriminators(compiler._scored(spark, FOLDER), anchors).collect(), key=lambda r: r["no"])
    patterns = {}
    for r in picked:
        patterns.setdefault((r["keyword"], r["entry_id"]), []).append(r["pattern"])
    want = {e: P.joined_pattern(list(dict.fromkeys(p))) for e, p in patterns.items()}
    got = {(r["keyword"], r["entry_id"]): r["pattern"] for r in compiler.QUERIES["p6_compile_pattern"](spark, FOLDER).collect()}
    assert got == want
    best = {}
    for r in sorted(scored, key=lambda r: (r["no"], -r["points"], r["idx"])):
        best.setdefault((r["keyword"], r["entry_id"]), {}).setdefault(r["no"], []).append(r["stem"] + "*")
    tiers = {e: {t: P.joined_pattern(["&".join(s[:n]) for s in v.values()], cluster=False) for t, n in (("best3", 3), ("best4", 4), ("all", 99))} for e, v in best.items()}
    rows = compiler.QUERIES["p7_tier_patterns"](spark, FOLDER).collect()
    assert len(rows) == len(want)
    for r in rows:
        entry = (r["keyword"], r["entry_id"])
        assert r["pattern"] == (want[entry] if r["tier"] in ("compiled", "none") else tiers[entry][r["tier"]])
