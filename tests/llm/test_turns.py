"""Conversation repair against an exhaustive search, and on rows of every kind."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from kbspark.llm import turns

FORM = re.compile(r"(s?(ua)+)?$")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [] if hit == 0 else [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Best first over (cost, audit): every sequence of edits in order of cost, then audit, until one gives the form."""
    faults = plain_faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if i == len(rows) and FORM.match(initials):
            return cost, audit, "\n".join(lines)
        # what follows depends on the last initial alone, and on whether there is one
        if (i, initials[-1:], len(initials) > 0) in done:
            continue
        done.add((i, initials[-1:], len(initials) > 0))
        steps = [(3, "I", i, r[0], (f"{r}:",)) for r in ("user", "assistant")]
        if i < len(rows):
            _, _, role, text = rows[i]
            steps.append((4, "D", i + 1, "", ()))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                steps += [(3 + more, "R", i + 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
                steps.append((more, "K", i + 1, role[:1] or "-", (f"{role}:{text}",)))
        for c, edit, j, initial, line in steps:
            grown = initials + initial
            if FORM.match(grown) or FORM.match(grown + "a") or FORM.match(grown + "ua"):
                heapq.heappush(heap, (cost + c, audit + edit, j, grown, lines + line))
    raise AssertionError("no repair")


def plain(rows):
    out = []
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        left = plain_damage(own)
        faults, initials = plain_faults(left), [r[2][:1] for r in left]
        numbered = [r[1] for r in left if r[1] is not None]
        cost, audit, text = plain_repair(left)
        gaps = max(numbered) - min(numbered) + 1 - len(set(numbered)) if numbered else 0
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def made(spark, rows, kind="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(rows, kind).withColumnRenamed("conv_id", "conv")
    damaged = turns.damaged(df)
    return [tuple(r) for r in turns.with_digests(damaged, turns.plans(damaged)).collect()]


def random_rows(rnd, convs, most):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "Uber", None]
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t\n", "a.b", "Yes. ", "é?", None]
    return [(c, t, rnd.choice(roles), rnd.choice(texts)) for c in range(convs) for t in range(rnd.randrange(0, most))]


def test_random_conversations(spark):
    rows = random_rows(random.Random(3), 250, 14)
    assert sorted(made(spark, rows)) == sorted(plain(rows))


def test_rows_of_every_kind(spark):
    rows = [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 7, "assistant", "b."), (1, 3, "user", "x."), (1, 3, "user", "x."), (1, 3, "assistant", "y."), (2, 5, None, None), (3, None, None, None), (4, -2, "user", "q?"), (4, 9, "assistant", "w " * 50000 + "."), (0, 30, "user", "gone?")]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(made(spark, rows), key=key) == sorted(plain(rows), key=key)
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert made(spark, [(dropped, 0, "user", "a.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert made(spark, []) == []


def test_segments_change_nothing():
    rnd = random.Random(8)
    for n in [0, 1, 2, *range(3, 60, 3)]:
        codes = bytes(rnd.randrange(16) for _ in range(n))
        assert len({turns.repair(codes, k) for k in (1, 2, 7, 1000)}) == 1


def test_long_conversation():
    rnd = random.Random(9)
    codes = bytes(4 * (1 + i % 2) if rnd.random() < 0.75 else rnd.randrange(16) for i in range(60_000))
    cost, audit = turns.repair(codes)
    assert len(audit) - audit.count("I") == len(codes)
    assert cost == turns.repair(codes, 60_000)[0]


@pytest.mark.parametrize("kind", ["conv_id string, turn int, role string, text string"])
def test_other_types(spark, kind):
    rows = [(str(c), t, r, x) for c, t, r, x in random_rows(random.Random(5), 40, 6)]
    assert {(int(r[0]), *r[1:]) for r in made(spark, rows, kind)} == set(plain([(int(c), t, r, x) for c, t, r, x in rows]))


def test_repaired_turns_have_the_form(spark):
    df = turns.damaged(spark.createDataFrame(random_rows(random.Random(6), 60, 9), "conv long, turn long, role string, text string"))
    plans = turns.plans(df)
    out = {}
    for r in sorted(turns.repaired(df, plans).collect(), key=lambda r: (r["conv"], r["place"])):
        out.setdefault(r["conv"], []).append(r)
    for r in plans.collect():
        turns_ = out.get(r["conv"], [])
        assert FORM.match("".join(t["role"][0] for t in turns_)) and [t["place"] for t in turns_] == list(range(len(turns_)))
        assert "".join(t["edit"] for t in turns_) == r["audit"].replace("D", "")
