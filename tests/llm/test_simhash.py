import random

import xxhash

from kbspark.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_is_the_definition():
    rnd = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(rnd.choice(["The", "É", "of\tx", "a b", "Q"]) for _ in range(n))
        assert simhash.fingerprint_of(text) == plain_fingerprint(text)
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of(" \n") == 0


def test_links_and_components_against_brute_force(spark):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    hub = rnd.getrandbits(64)  # a ball of near copies: sets far above PAIRWISE, in both halves
    for _ in range(500):
        f = hub
        for _ in range(rnd.randrange(0, 4)):
            f ^= 1 << rnd.choice([*range(10), *range(32, 42), rnd.randrange(64)])
        fps.add(f)
    chain = rnd.getrandbits(64)
    for b in range(0, 40, 2):  # each link two bits on
        fps.add(chain)
        chain ^= 3 << b
    fps = sorted(fps, key=signed)
    got = simhash.components(simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))).collect()
    got = {r["id"]: r["root"] for r in got}
    want = plain_components(fps)
    assert [got.get(signed(f), signed(f)) for f in fps] == [signed(fps[w]) for w in want]
    for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect():
        assert (r["a"] ^ r["b"]) & (2**64 - 1) and ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2


def test_edge_rows(spark, documents):
    rows = simhash.near_duplicates(documents).collect()
    assert len(rows) == documents.count()
    of = {r["doc_id"]: (r["fp"], r["component_id"]) for r in rows}
    assert of[2] == of[3] == of[6] == (0, 2)
    assert of[1][1] == of[5][1] == 1
    assert of[None][1] is None
    assert simhash.near_duplicates(documents.limit(0)).count() == 0
