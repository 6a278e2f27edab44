from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from spanloom.llm import langid

WORDS = {"aa": "the of and with from then they were".split(), "bb": "der die und nicht einer haben schön".split(), "cc": "que los para niño año más está".split()}


def docs(spark, n=300):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 60))) + " 12 . ", lang, "s") for i in range(n) for lang in [rng.choice([*WORDS])]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy(spark):
    d = docs(spark)
    filters = langid.learn(d.where(~langid.held_out()))
    got = langid.identify(d.select("*", langid.held_out().alias("held")), filters).where("held").collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_are_those_of_the_checksum(spark):
    import zlib

    got = spark.range(200).select("id", langid.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_awkward_texts(spark):
    filters = langid.learn(docs(spark))
    texts = [None, "", "12 34 !?", "a", "THE", "x" * 300000, "北京", "the und " * 50, "ǅ ß İ", "\n\t"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(d, filters).collect()}
    assert [got[i] for i in (0, 1, 2, 9)] == ["und"] * 4
    assert all(got[i] in WORDS for i in (3, 4, 5, 6, 7, 8))
    nothing = langid.learn(docs(spark).where("false"))
    assert [r.lang_pred for r in langid.identify(d, nothing).collect()] == ["und"] * len(texts)
    unlabelled = langid.learn(docs(spark).withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.langs == []
    assert langid.identify(d.where("false"), filters).count() == 0


def test_filters_give_all_languages_of_a_gram_and_few_false_ones():
    import numpy as np

    rng = np.random.default_rng(1)
    grams = {f"l{k:03d}": rng.integers(0, 1 << 63, 500) for k in range(70)}  # more than a word of languages
    shared = rng.integers(0, 1 << 63, 20)
    for g in grams.values():
        g[:20] = shared
    f = langid.Filters(sorted(grams), grams, bits=14)
    for word in range(2):
        found = np.full(20, ~np.uint64(0))
        for p in langid.positions(shared.view(np.uint64), 14):
            found &= f.slices[word][p]
        assert (np.bitwise_count(found) == (64, 6)[word]).all()
    assert (f.false_rate < 0.01).all()


def plain(rows, held, texts):
    """Predictions from sets of n-grams instead of filters, learned from the rows that are not held out."""
    from collections import Counter

    def grams(text):
        said = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
        return [said[k : k + 4] for k in range(len(said) - 3)] if len(said) >= 4 else [said + " " * (4 - len(said))] if len(said) == 3 else []

    counts, sizes = {}, Counter()
    for i, text, lang in rows:
        if lang is not None and text is not None and not held[i]:
            sizes[lang] += 1
            counts.setdefault(lang, Counter()).update(set(grams(text)))
    rate = {(lang, g): n / sizes[lang] for lang, c in counts.items() for g, n in c.items() if n > 1}
    best = {}
    for (_, g), r in rate.items():
        best[g] = max(best.get(g, 0), r)
    own = {lang: {g for (l, g), r in rate.items() if l == lang and r >= langid.OWN * best[g]} for lang in counts}
    out = []
    for text in texts:
        hits = {lang: sum(g in own[lang] for g in grams(text or "")) for lang in sorted(own)}
        out.append(max(hits, key=hits.get) if any(hits.values()) else None)
    return out


def test_filters_decide_as_sets_do(spark):
    rng = random.Random(8)
    letters = "abcdeéfghä"
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(80)] for lang in ("aa", "bb", "cc", "dd")}
    rows = [(i, " ".join(rng.choice(words[lang if rng.random() < 0.7 else "aa"]) for _ in range(rng.randint(4, 60))), lang) for i in range(500) for lang in [rng.choice([*words])]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id: r.h for r in d.select("doc_id", langid.held_out().alias("h")).collect()}
    got = {r.doc_id: r.lang_pred for r in langid.identify(d, langid.learn(d.where(~langid.held_out()))).collect()}
    want = plain(rows, held, [t for _, t, _ in rows])
    assert sum(got[i] == w for (i, _, _), w in zip(rows, want)) >= 0.995 * len(rows)


def test_the_sample_has_the_least_hashes(spark, monkeypatch):
    d = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "aa").when(F.col("id") % 30 == 0, "bb").otherwise("cc").alias("lang"))
    hashed = d.select("id", "lang", F.xxhash64("id").alias("h")).collect()
    want = {lang: sorted((r.h, r.id) for r in hashed if r.lang == lang)[:200] for lang in ("aa", "bb", "cc")}
    for counted in (1 << 4, 1 << 16):
        monkeypatch.setattr(langid, "COUNTED", counted)
        got = langid.sampled(d, "id", "lang", 200).collect()
        assert sorted((r.lang, r.id) for r in got) == sorted((lang, i) for lang, some in want.items() for _, i in some)


def test_names_of_columns_do_not_clash(spark):
    d = docs(spark, 60).selectExpr("*", "1 as judged", "'x' as `row`", "'y' as lang_pred", "doc_id as id")
    got = langid.identify(d, langid.learn(d))
    assert got.columns == ["doc_id", "text", "lang", "judged", "row", "id", "lang_pred", "score"]
    assert sorted(r.id for r in got.collect()) == list(range(60))
