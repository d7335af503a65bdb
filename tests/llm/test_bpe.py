import random
import time

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from kbspark.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_against_tiktoken():
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab cde\n\tthe12éß漢字😀 ​²½ıⅣ\x1c\x85 '") for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["".join(rnd.choice("etaoins") for _ in range(n)) for n in (1, 50, 5000)] + ["a" * 3000, "ab" * 2000, " " * 900, "", None]
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text or "")
        assert codec.decode(ids) == (text or "").encode()


def test_query_rows(spark, documents):
    rows = queries.encoded(spark, documents).collect()
    assert len(rows) == documents.count()
    empty = [r for r in rows if r["doc_id"] in (2, 3)]
    assert {(r["n_tokens"], r["ids_sha256"] == r["decoded_sha256"]) for r in empty} == {(0, True)}
    assert queries.encoded(spark, documents.limit(0)).count() == 0
    assert documents.select(F.sha2(F.coalesce("text", F.lit("")), 256)).collect()[0][0] in {r["decoded_sha256"] for r in rows}


def test_long_pre_tokens_that_repeat():
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(2)
    for unit in ("the", "ab", "aab", "thei", "éab", "ing", "==-"):
        text = unit * 2000 + "".join(rnd.choices(unit, k=3000))
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == other.encode_ordinary(text)
    for unit in ("the", "ab"):
        took = []
        for n in (15_000, 90_000):
            began = time.process_time()
            codec.merged([(unit * n)[:n].encode()])
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0]  # six times the letters; the square would be 36 times
