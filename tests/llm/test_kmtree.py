from __future__ import annotations

import numpy as np

from spanloom.llm import kmtree


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for i, q in ok:
        if i % 50 == 0:
            near = sorted((-(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v)), j) for j, v in ok if j != i)
            out[i] = [j for _, j in near[:k]], [-s for s, _ in near[:k]]
    return out


def run(spark, rows, k=5, sample=20000):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as leaf", "2 as id").repartition(4)
    got = {}
    for r in kmtree.search(df, k, lambda c: c % 50 == 0, sample=sample).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, ([], []))
        got[r.query_id][0].append(r.vec_id)
        got[r.query_id][1].append(r.score)
        assert r["rank"] == len(got[r.query_id][0])
    return got


def test_recall_on_clusters_and_noise(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(kmtree, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(2000)] + [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(2000, 3000)]
    got, want = run(spark, rows, sample=1500), brute(rows, 5)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q][0]) & set(want[q][0])) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q in want:
        for j, s in zip(*got[q]):
            if j in want[q][0]:
                assert abs(s - want[q][1][want[q][0].index(j)]) < 1e-12


def test_awkward_vectors(spark):
    same = [1.0, 2.0]
    rows = [(0, same), (50, [float("nan"), 1.0]), (100, None), (150, [0.0, 0.0]), (200, [float("inf"), 1.0]), (250, [1.0, None]), (300, [2.0**-90, 2.0**-89]), (350, [3.0, -1.0])] + [(k, same) for k in range(1, 40)] + [(7, same), (None, same)]
    got = run(spark, rows)
    assert sorted(got) == [0, 300, 350]
    assert got[0][0] == [1, 2, 3, 4, 5] and got[300][0] == [0, 1, 2, 3, 4] and got[350][0] == [0, 1, 2, 3, 4]
    assert run(spark, [(0, same)]) == {}
    assert run(spark, rows[:1] + [(3, [1.0, 0.0])])[0][0] == [3]
    assert run(spark, []) == {}


def test_outliers_get_k_neighbours(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "calibrate", lambda *_: 1)  # as with tight clusters
    rng = np.random.default_rng(6)
    rows = [(i, (np.eye(8)[i % 4] + 1e-3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(1, 1200) if i % 50]
    rows += [(50 * k, (-np.eye(8)[k]).astype(np.float32).tolist()) for k in range(8)]
    got = run(spark, rows)
    assert sorted(got) == [50 * k for k in range(8)] and all(len(x[0]) == 5 for x in got.values())


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(60)] + [(100, [1.0, 2.0]), (150, [1.0]), (200, []), (250, [1.0, 2.0, 3.0, 4.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = kmtree.search(d, 5, lambda i: i % 50 == 0).collect()
    assert {r.query_id for r in got} == {0, 50} and len(got) == 10 and all(r.vec_id < 60 for r in got)
