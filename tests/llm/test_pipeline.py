"""Each stage of the pipeline against plain Python on what the stage before it kept."""

from __future__ import annotations

import random

import public_tokenizers
from test_linededup import plain as removed_lines
from test_simhash import groups
from test_simhash import plain as fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm.common import stash

WORDS = {"aa": "the of and with from then they were".split(), "bb": "der die und nicht einer haben".split()}


def write(spark, path):
    rng = random.Random(12)
    vocabulary = {k: v + ["".join(rng.choice(v) for _ in range(2)) for _ in range(200)] for k, v in WORDS.items()}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    items = [(1, say("aa", 40)), (2, say("bb", 12))]
    rows = []
    for i in range(160):
        lang = ["aa", "bb"][i % 2]
        rows.append((i, "\n".join(say(lang, rng.randint(8, 40)) for _ in range(rng.randint(1, 6))), lang, f"s{i % 5}"))
    rows += [(200 + k, rows[k][1], rows[k][2], "copy") for k in range(10)]
    rows += [(220 + k, rows[k][1].replace("the", "then", 1), rows[k][2], None) for k in range(20, 30)]
    rows += [(300, "12345 !!!", "aa", "s"), (301, None, "aa", "s"), (302, "北京" * 40, None, "s"), (303, say("aa", 9) + " " + items[0][1], "aa", "s"), (304, "", "bb", "s"), (305, say("bb", 9000), "bb", "s"), (None, say("aa", 30), "aa", "s")]
    rows = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1.5 as score", "'x' as row", "7 as id").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return items


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    items = write(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    assert len(columns) == 8
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stash(stage(spark, docs, path), f"test{k}")
        after.append([tuple(r) for r in docs.collect()])
        if k < 4:
            assert docs.columns == columns
    # language: what has letters of a learned language stays
    assert sorted(after[0], key=str) == sorted((r for r in rows if r[0] not in (300, 301, 302, 304)), key=str)
    # lines
    gone = removed_lines([(r[0], r[1]) for r in after[0]])
    want = []
    for i, t, *rest in after[0]:
        left = [x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())]
        if left:
            want.append((i, "\n".join(left), *rest[:2], len("\n".join(left)), *rest[3:]))
    assert sorted(after[1], key=str) == sorted(want, key=str)
    assert not {r[0] for r in after[1]} & {200 + k for k in range(10)}
    # near duplicates
    prints = {r[1]: fingerprint(r[1]) for r in after[1]}
    texts = list(prints)
    root = groups([(a, b) for a in range(len(texts)) for b in range(a) if bin(prints[texts[a]] ^ prints[texts[b]]).count("1") <= 2], range(len(texts)))
    least = {}
    for r in after[1]:
        if r[0] is not None:
            g = root[texts.index(r[1])]
            least[g] = min(r[0], least.get(g, r[0]))
    assert sorted(after[2], key=str) == sorted((r for r in after[1] if r[0] is None or least[root[texts.index(r[1])]] == r[0]), key=str)
    # benchmark
    held = lambda t: any(" ".join(item.split()[a : a + 10]) in " ".join(t.split()) for _, item in items for a in range(len(item.split()) - 9))
    assert sorted(after[3], key=str) == sorted((r for r in after[2] if not held(r[1])), key=str)
    assert 303 not in {r[0] for r in after[3]}
    # packing
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r[0]: len(t.encode(r[1], add_special_tokens=False).ids) + 1 for r in after[3]}
    packed = docs.collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == tokens
    assert len({r.sequence_id for r in packed}) <= sum(tokens.values()) // 2048 + 2
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).drop("sequence_id", "offset").collect()), key=str) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()), key=str)
