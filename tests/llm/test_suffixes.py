from __future__ import annotations

import hashlib
import random

from spanloom.llm import suffixes


def plain(rows):
    """doc_id -> (bytes, removed, spans, hash) by looking at every string."""
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        if i is not None:
            for p in range(len(data) - 49):
                s = data[p : p + 50]
                first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        if i is not None:
            for p in range(len(data) - 49):
                if first[data[p : p + 50]] < i:
                    gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "x").selectExpr("*", "1 as row", "2 as spans").repartition(5)
    got = sorted((tuple(r) for r in suffixes.digest(suffixes.repeated_spans(docs)).collect()), key=str)
    assert got == plain(rows)


def test_repeats_of_all_kinds(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghé ") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (5, 8, 9, 10, 12, 14, 20, 60, 200)]
    rows = []
    for i in range(150):
        text = prose(rng.randint(0, 40))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            text += p[a : a + rng.randint(20, 400)] + prose(rng.randint(0, 15))
        rows.append((i * 3 - 40, text))
    rows += [(500 + k, rows[k][1]) for k in range(20)]
    rows += [(700 + k, rows[k][1][: len(rows[k][1]) // 2] + "X" + rows[k][1][len(rows[k][1]) // 2 :]) for k in range(20, 40)]
    rows += [(800, "a" * 3000), (801, "a" * 49), (802, "a" * 50), (803, "ab" * 700), (804, "ba" * 700), (805, None), (806, ""), (None, rows[3][1]), (None, None)]
    rows += [(900, rows[60][1] * 2), (900, rows[60][1] + "tail"), (901, "x" + rows[60][1])]
    check(spark, rows)
    assert suffixes.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_are_cut_into_segments(monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.choice(b"abc") for _ in range(5000))
    whole = [x for f, h, b in suffixes.suffixes([data]) for x in zip(*f.strings(__import__("numpy").arange(len(f.first)), h, b)[1:])]
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    parts = [x for f, h, b in suffixes.suffixes([data, data[:100], b"", data]) for t, *x in zip(*f.strings(__import__("numpy").arange(len(f.first)), h, b)) if t == 3]
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_batches_are_cut_by_bytes(monkeypatch):
    import numpy as np
    import pandas as pd

    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcde ") for _ in range(rng.randint(50, 300))) for _ in range(40)]
    batch = pd.DataFrame({"id": np.arange(40) * 7, "text": texts})
    needs = lambda f, h, base: (f.anchor, f.text)

    def pairs():
        got = list(suffixes._by_batch([batch], needs))
        return len(got), {(int(a), int(ids[t])) for ids, c in got for a, t in zip(*c)}

    whole = pairs()
    monkeypatch.setattr(suffixes, "BATCH", 1000)
    parts = pairs()
    assert whole[0] == 1 < parts[0] and whole[1] == parts[1]
    assert list(suffixes._by_batch([batch.iloc[:0]], needs))[0][1] is None


def without_spark(rows, hot=False, batches=4):
    """The passes on plain frames: what a cluster does with batches of rows, in this process."""
    import numpy as np
    import pandas as pd

    class Frame:
        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda x: type("B", (), {"value": x}))})})

        def mapInPandas(self, f, schema):
            return f

    every = type("Every", (), {"has": lambda self, keys: np.ones(len(keys), bool)})()
    frame = pd.DataFrame([(i, t.encode(), k) for k, (i, t) in enumerate(rows) if len(t.encode()) >= 50], columns=["id", "text", "h"])
    digits = np.unique(np.concatenate([f.anchor for f, _, _ in suffixes.suffixes(frame["text"].tolist())])) if hot else np.zeros(0, np.uint64)
    send = suffixes._sorted_by(Frame(), 4, every, digits)
    sent = pd.concat([x for k in range(2) for x in send(iter([frame[2 * j + k :: batches] for j in range(batches // 2)]))])
    met = pd.concat([suffixes._meet(4)(b.reset_index(drop=True)) for _, b in sent.groupby("part")])
    runs = pd.concat([suffixes._merge(b) for _, b in met.groupby("bucket")])
    return {r.h: list(zip(r.starts.tolist(), r.ends.tolist())) for r in runs.itertuples()}


def test_hot_digits_common_contexts_and_equal_hashes(monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, passages = prose(40), [prose(n) for n in (6, 9, 12, 30)]
    rows = [(i // 2 if i % 9 == 0 else i - 30, prose(rng.randint(0, 20)) + (common if i % 3 else "") + prose(rng.randint(0, 9)) + rng.choice(passages)[rng.randint(0, 9) :] * rng.randint(1, 3)) for i in range(90)]
    first = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    want = {}
    for k, (i, t) in enumerate(rows):
        gone = [False] * (len(t) + 1)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        edges = [p for p in range(len(gone)) if gone[p] != (p > 0 and gone[p - 1])]
        if edges:
            want[k] = list(zip(edges[::2], edges[1::2]))
    assert want and without_spark(rows) == want
    assert without_spark(rows, hot=True) == want
    monkeypatch.setattr(suffixes, "OFTEN", 2)
    monkeypatch.setattr(suffixes, "REMEMBERED", 20)
    assert without_spark(rows) == want
    whole = suffixes._mix
    monkeypatch.setattr(suffixes, "_mix", lambda h: whole(h) & __import__("numpy").uint64(0xF << 60))
    assert without_spark(rows) == want


def test_small_results_are_written_to_few_files(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    stashed, stash = [], suffixes.stash
    monkeypatch.setattr(suffixes, "stash", lambda *a: stashed.append(out := stash(*a)) or out)
    common = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(4000)) + common) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        suffixes.digest(suffixes.repeated_spans(docs)).write.parquet(f"{tmp_path}/out")
        got = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain(rows)
    assert len(list((tmp_path / "out").glob("part-*"))) <= 2
    assert [len(x.inputFiles()) <= 2 for x in stashed] == [True]
