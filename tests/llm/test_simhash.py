from __future__ import annotations

import random

import pytest
import xxhash

from spanloom.llm import simhash
from spanloom.llm.components import connected_components


def plain(text):
    words = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "):
        if w:
            words.append(w)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def groups(edges, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def test_fingerprint_of_edge_texts():
    for t in ["", " \t\n", "One", "one TWO", "a b c", "A B C a b c a b c", "é É x y\x0bz\x1cq", "w " * 5000]:
        assert simhash.fingerprint_of(t.encode()) == plain(t)
    assert simhash.fingerprint_of(None) == 0


@pytest.mark.parametrize("wide", [256, 2])
def test_links_join_all_within_two_bits(spark, wide):
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        values.add(seed)
        for _ in range(14):
            x = seed
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values |= {0, 1, 3, 7}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = [(r.u, r.v) for r in simhash.links(fps, wide).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in got)
    true = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    assert groups(got, signed) == groups(true, signed)


def test_near_duplicates_of_awkward_rows(spark):
    long = "word%d " * 3 % (1, 2, 3) * 20000
    rows = [(5, "a b c d", "x"), (2, "A  b c D", "y"), (9, None, "z"), (4, "", "z"), (7, long, None), (7, long, None), (None, "q r s", "n"), (8, long + "tail", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.id, r.component) for r in simhash.near_duplicates(docs).collect()), key=str)
    fps = {t: plain(t) for _, t, _ in rows}
    texts = list(fps)
    near = [(a, b) for a in range(len(texts)) for b in range(a) if bin(fps[texts[a]] ^ fps[texts[b]]).count("1") <= 2]
    root = groups(near, range(len(texts)))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[root[texts.index(t)]] = min(i, least.get(root[texts.index(t)], i))
    assert got == sorted(((i, least.get(root[texts.index(t)])) for i, t, _ in rows), key=str)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (7, None)], "u long, v long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    want = groups(edges, {x for a, b in edges if a != b for x in (a, b)})
    assert got == want
    assert connected_components(df.where("false")).count() == 0
