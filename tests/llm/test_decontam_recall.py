"""Benchmark items at the largest edit distance that counts, by length, and items of a few letters."""

import random

import pytest

from kbspark.llm import decontam


def edited(rnd, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(chars))
        chars[at : at + rnd.randrange(2)] = rnd.choice(["", *"etaoin "])
    return "".join(chars)


@pytest.mark.parametrize("letters", [48, 80, 120, 250])
def test_recall(letters):
    rnd = random.Random(letters)
    word = lambda: "".join(rnd.choice("etaoinshrdlucmfw") for _ in range(rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(letters))[:letters]) for i in range(100)]
    rest = lambda: " ".join(word() for _ in range(40))
    texts = [decontam.normalised(f"{rest()} {edited(rnd, t, int(len(t) * decontam.EDITS))} {rest()}") for _, t in items]
    found = decontam.Index(items).search(texts)
    assert all(text == item for text, item, *_ in found)
    assert len(found) >= 94


@pytest.mark.parametrize("letters", [15, 25, 39, 40, 64, 65, 84, 85, 99, 100, 150, 400])
def test_target_recall_in_every_class(letters):
    """At the largest distance that counts, around the places where the classes and the windows needed change."""
    rnd = random.Random(letters)
    word = lambda: "".join(rnd.choice("etaoinshrdlucmfw") for _ in range(rnd.randrange(2, 9)))
    items = [(i, (" ".join(word() for _ in range(letters))[: letters - 1]).strip().ljust(letters, "x")) for i in range(100)]
    rest = lambda: " ".join(word() for _ in range(40))
    texts = [decontam.normalised(f"{rest()} {edited(rnd, t, int(letters * decontam.EDITS))} {rest()}") for _, t in items]
    found = {(text, item) for text, item, *_ in decontam.Index(items).search(texts)}
    within = [i for i, t in items if decontam.edit_search(t, texts[i])[0] <= int(letters * decontam.EDITS)]
    assert sum((i, i) in found for i in within) >= decontam.TARGET_RECALL * len(within)


def test_rows(spark):
    """Ties go to the first place; null and repeated keys, null items, very long texts and clashing columns."""
    item = "the seven grey horses of the valley run at noon past the mill"
    rows = [(1, f"{item} and again {item}"), (2, None), (3, ""), (None, item), (None, item), (4, "word " * 200_000 + item), (5, item.upper().replace(" ", ", "))]
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], "doc_id long, text string, f string, item_id string, edits int")
    bench = spark.createDataFrame([(7, item, 1), (7, item, 1), (None, item, 2), (8, None, 3), (9, "", 4)], "item_id long, text string, key int")
    got = sorted((str(r["doc_id"]), r["item_id"], r["start"], r["edits"]) for r in decontam.contaminations(docs, bench).collect())
    assert set(got) == {("1", 7, 0, 0), ("None", 7, 0, 0), ("4", 7, 1_000_000, 0), ("5", 7, 0, 0)} and len(got) == 10
    assert [r["doc_id"] for r in decontam.uncontaminated(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    assert decontam.uncontaminated(docs, bench).columns == docs.columns


def test_items_of_few_letters():
    index = decontam.Index([(1, "Yes!"), (2, "no, never"), (3, "?"), (4, None), (5, "yes"), (6, "seven")])
    texts = [decontam.normalised(x) for x in ("YES", "oh yes", "well, No: never.", "no one ever", "", "no nevr, no never", "in any case no neverland", "Seve", "seve n", "eleven")]
    assert index.search(texts) == [(0, 1, 0, 3, 0), (0, 5, 0, 3, 0), (2, 2, 5, 13, 0), (5, 2, 8, 16, 0), (7, 6, 0, 4, 1)]


@pytest.mark.parametrize("letters", [2, 4, 5, 6, 9, 10, 11])
def test_items_of_few_letters_against_every_span(letters):
    """All whole words of a text against all items by the plain edit distance."""
    rnd = random.Random(letters)
    word = lambda: "".join(rnd.choice("etao") for _ in range(rnd.randrange(1, 7)))
    items = [(i, decontam.normalised(" ".join(word() for _ in range(9))[:letters])) for i in range(40)]
    texts = [" ".join(word() for _ in range(60)) for _ in range(5)] + [word() for _ in range(20)]
    want = []
    for n, text in enumerate(texts):
        cuts = [-1, *(k for k, c in enumerate(text) if c == " "), len(text)]
        for i, t in items:
            spans = [(a + 1, b) for k, a in enumerate(cuts) for b in cuts[k + 1 :] if b - a < 16 and (" " in text[a + 1 : b] or len(cuts) == 2)]
            near = [(d, b, a) for a, b in spans if (" " in t or " " not in text[a:b]) and (d := decontam.distance(t, text[a:b])) <= int(len(t) * decontam.EDITS)]
            if near:
                edits, end, start = min(near)
                want.append((n, i, start, end, edits))
    assert decontam.Index(items).search(texts) == sorted(want)


def test_parts_find_what_the_whole_finds(monkeypatch):
    """Few hits held at once, so that starts are taken in parts and places in many batches."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 8, 12, 25, 60] * 5)]
    texts = [decontam.normalised(" ".join([word() for _ in range(100)] + [edited(rnd, rnd.choice(items)[1], 2) for _ in range(20)])) for _ in range(4)] + [""]
    whole = decontam.Index(items).search(texts)
    monkeypatch.setattr(decontam, "HELD", 20_000)
    monkeypatch.setattr(decontam, "TOGETHER", 1024)
    assert decontam.Index(items).search(texts) == whole and len(whole) > 40
