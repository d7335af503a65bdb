"""Page texts and chunks against a second, plain reading of the same pages."""

import os
import re
from html import unescape

import pytest

from kbspark import plans
from kbspark.operators import indexing as I

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain_words(page):
    """The words of a page's article, or of all but its head, scripts and navigation, by cutting strings."""
    page = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|nav|head)\b.*?</\1>", " ", page)
    found = re.search(r"(?is)<(article|main)\b[^>]*>(.*?)(</\1>|\Z)", page)
    body = found[2] if found else re.sub(r"(?is)<(header|footer|aside)\b.*?</\1>", " ", page)
    return unescape(re.sub(r"(?s)<[^>]*>", " ", body)).split()


def test_page_texts(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = {r["source_id"]: r["text"] for r in plans.queries()["i1_html_to_text"](spark, FOLDER).collect()}
    assert set(got) == set(pages)
    same = [i for i in pages if "".join(got[i].split()) == "".join(plain_words(pages[i]))]
    assert len(same) == len(pages)


def test_chunks_hold_every_word_once_but_for_the_overlap(spark):
    texts = {r["source_id"]: r["text"] for r in plans.queries()["i1_html_to_text"](spark, FOLDER).collect()}
    texts |= {-1: "\n\n".join(" ".join(f"w{i}-{j}" for j in range(60)) for i in range(40)), -2: None, -3: "few words here"}
    df = spark.createDataFrame(list(texts.items()), "source_id long, text string")
    chunks = {}
    for r in sorted(I.chunk_text(df).collect(), key=lambda r: r["chunk_index"]):
        chunks.setdefault(r["source_id"], []).append(r["content"].split())
        assert r["word_count"] == len(r["content"].split())
    for source, text in texts.items():
        words, own = (text or "").split(), chunks.get(source, [])
        if len(words) < I.LEAST_WORDS:
            assert not own
            continue
        joined = list(own[0])
        for before, chunk in zip(own, own[1:]):
            tail = next(n for n in range(min(I.OVERLAP, len(before)), -1, -1) if before[len(before) - n :] == chunk[:n])
            assert tail > 0
            joined += chunk[tail:]
        assert joined == words[: len(joined)] and len(words) - len(joined) < I.LEAST_WORDS
    assert len(chunks[-1]) > 5 and all(len(c) <= I.CHUNK_WORDS + I.OVERLAP + 60 for c in chunks[-1])
