from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from test_simhash import groups

from spanloom.llm import neardup


def five(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stage_joins_all_of_five_word_jaccard(spark):
    """Families with a few words replaced, against brute force; their 3-word SimHashes differ by far more than 2 bits."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 4)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    rows += [(500, "three words here"), (501, "Three  words HERE"), (502, "three words there"), (None, rows[0][1]), (503, rows[0][1]), (503, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as key").repartition(4)
    sets = [five(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert sum(rows[a][1] != rows[b][1] for a, b in near) > 30
    root = groups(near, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = [r for k, r in enumerate(rows) if r[0] is None or least[root[k]] == r[0]]
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_fingerprints_are_majorities_of_all_shingles():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False)) for n in (1, 2, 7, 8, 254, 255, 256, 700, 1, 40_000)]
    for s, got in zip(sets, neardup.fingerprints(sets)):
        bits = np.unpackbits(neardup.bits_of(s).view(np.uint8), axis=1, bitorder="little")
        ones = bits.sum(axis=0, dtype=np.int64)
        want = [1 if 2 * c > len(s) else 0 if 2 * c < len(s) else b for c, b in zip(ones.tolist(), bits[0].tolist())]
        assert np.unpackbits(got, bitorder="little").tolist() == want


@pytest.mark.parametrize("whole", [True, False])
def test_values_with_one_bit_deleted_meet(whole):
    """Against all pairs: one bit of the lower half apart, and the same value if ``whole``; wide values too."""
    rng = random.Random(5)
    rows = np.zeros(1500, neardup._ROW)
    rows["h"] = np.arange(1500)
    rows["bits"] = [rng.randrange(4) << 10 | rng.choice([rng.randrange(1024), 0, 1 << rng.randrange(10)]) for _ in range(1500)]
    rows["bits"][::300] = 77 << 10
    rows["size"] = [rng.choice([10, 13, 30]) for _ in range(1500)]
    rows["check"] = [[0, rng.choice([0, 7, (1 << 50) - 1])] for _ in range(1500)]
    rng.shuffle(bits := rows["bits"].tolist())
    count = {b: bits.count(b) for b in bits}
    rows["bits"] = bits
    pairs = []
    for a in range(1500):
        for b in range(a):
            apart = bits[a] ^ bits[b]
            if apart.bit_count() > 1 or apart >> 10 or not (whole or apart):
                continue
            alike = abs(int(rows["size"][a]) - int(rows["size"][b])) <= 5 and int(rows["check"][a][1] ^ rows["check"][b][1]).bit_count() <= neardup.RADIUS
            if alike or max(count[bits[a]], count[bits[b]]) > neardup.WIDE:
                pairs.append((a, b))
    if not whole:  # texts of wide values meet through values a bit apart
        near = {bits[a] for a, b in pairs if max(count[bits[a]], count[bits[b]]) > neardup.WIDE} | {bits[b] for a, b in pairs if max(count[bits[a]], count[bits[b]]) > neardup.WIDE}
        pairs += [(a, b) for a in range(1500) for b in range(a) if bits[a] == bits[b] in near and count[bits[a]] > neardup.WIDE]
    root = groups(pairs, range(1500))
    label, h = neardup.meet(rows, 20, whole)
    got = dict(zip(h.tolist(), label.tolist()))
    assert len(got) == len(h) and set(got) == {x for p in pairs for x in p}
    assert all(got[a] == got[b] for a, b in pairs)
    assert len(set(got.values())) == len({root[x] for x in got})


@pytest.mark.parametrize("width, splits", [(20, 1), (20, 4), (28, 4), (32, 1)])
def test_candidates_share_a_segment_but_for_one_bit(spark, width, splits):
    """Fingerprints with one bit changed in one segment and three in all others meet, in either half and any part; others do not."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        base = rng.integers(0, 2, neardup.BITS, np.uint8)
        other = base.copy()
        for s in range(neardup.BITS // width):
            other[s * width + rng.permutation(width)[: 1 if s == k else 3]] ^= 1
        rows += [(2 * k, 100, np.packbits(base, bitorder="little").tobytes()), (2 * k + 1, 100, np.packbits(other, bitorder="little").tobytes())]
    reps = spark.createDataFrame(rows, "h long, n int, bits binary").repartition(5)
    together = {}
    for r in neardup.candidates(reps, width, 0, 0, 20, splits).collect():
        together.setdefault(r.key, set()).add(r.h)
    assert sorted(map(sorted, together.values())) == [[2 * k, 2 * k + 1] for k in range(20)]


def test_small_sets_with_one_shingle_more(spark):
    """Four shingles of five: their fingerprints differ most."""
    rng = random.Random(2)
    texts = [" ".join(f"{rng.random()}" for _ in range(rng.randint(9, 13))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, t.rpartition(" ")[0]) for k, t in enumerate(texts)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.id: r.component for r in found.collect()} == {i: i % 1000 for i, _ in rows}
