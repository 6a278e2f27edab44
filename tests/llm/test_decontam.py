from __future__ import annotations

import random

from spanloom.llm import decontam

ITEMS = [
    (1, "A train leaves the old station at 9:30 and travels 120 km to the coast while Alice waits for 45 minutes. When does it get there with 120 km done?"),
    (2, "short text"), (3, None), (4, ""), (5, "one rare sentence only here"), (None, "a b c d e f g h i j k l"),
]
FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def plain(texts, items):
    """The items that each text holds, by comparing every window of an item with every place of a text."""
    words = decontam.Words()

    def read(text):
        every = words.numbers(text)
        code, kind, at = words.template(every)
        exact = [int(x) for x in words.exact[every] if x]
        return [int(x) for x in code], [int(x) for x in kind], [words.text[i] for i in at], [bool(words.capital[i]) for i in at], [bool(words.unit[i]) for i in at], exact, 2 * int(words.single[at].sum()) > len(at)

    out = []
    for text in texts:
        held = []
        code, kind, said, _, _, exact, _ = read(text or "")
        for item, of in items:
            if item is None or of is None:
                continue
            c, k, s, capital, unit, e, unspaced = read(of)
            size = min(8, len(c))
            good = [q for q in range(len(c) - size + 1) if sum(x == 0 for x in k[q : q + size]) >= 4]
            if not good:
                if decontam.whole_runs(of) >= 3 and any(exact[p : p + len(e)] == e for p in range(len(exact) - len(e) + 1)):
                    held.append(item)
                continue
            needed = min(13 if unspaced else 3, len({tuple(c[q : q + size]) for q in good}))
            counted = set()
            for d in range(-len(c), len(code)):
                values, clear, own = {}, True, set()
                for q in good:
                    p = q + d
                    if p < 0 or p + size > len(code):
                        continue
                    same = code[p : p + size] == c[q : q + size]
                    begun = q == 0 and k[0] == 0 and (capital[0] and kind[p] == 3 or unit[0] and kind[p] == 4) and code[p + 1 : p + size] == c[1:size] and said[p] == s[0]
                    if same or begun:
                        own.add(tuple(c[q : q + size]))
                        for i in range(size):
                            if kind[p + i] > 0:
                                clear &= values.setdefault((kind[p + i], s[q + i]), said[p + i]) == said[p + i]
                if clear:
                    counted |= own
            if len(counted) >= needed:
                held.append(item)
        out.append(sorted(held))
    return out


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    got = decontam.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    return {r.id: list(r.items) for r in got}


def test_copies_and_reparameterised_items(spark):
    rng = random.Random(2)
    fill = lambda n: " ".join(rng.choice(FILLER) for _ in range(n))
    one = ITEMS[0][1]
    other = one.replace("120", "87").replace("9:30", "7:15").replace("Alice", "Bob").replace("45 minutes", "20 hours").replace("km", "miles")
    broken = one.replace("travels 120", "travels 87").replace("9:30", "7:15")  # the second 120 stays: its slots contradict
    texts = [fill(200), fill(30) + " " + one + " " + fill(900), fill(5) + " " + other, one.upper().replace(" ", "\n"), " ".join(one.split()[:12]), " ".join(one.split()[:9]), None, "", broken, "one rare sentence only here", "short text", fill(30000) + " " + one]
    got = found(spark, texts)
    assert [i for i, x in sorted(got.items()) if 1 in x] == [1, 2, 3, 4, 11]
    assert got[8] == [] and got[9] == [5] and got[5] == [] and got[10] == []
    assert got == {i: x for i, x in enumerate(plain(texts, ITEMS))}


def test_rows_are_kept_whole(spark):
    docs = spark.createDataFrame([(1, ITEMS[0][1], "s"), (2, "clean words", None), (2, "clean words", None), (None, None, "t")], "doc_id long, text string, windows string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontam.without_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == 3 and left.where("doc_id = 1").count() == 0
    assert decontam.contamination(docs.where("false"), bench).count() == 0
    assert decontam.contamination(docs, bench.where("false")).count() == 4


def test_exact_copies_of_short_arithmetic_unspaced_and_mid_line_items(spark):
    items = [
        (1, "What is 12 times 7?"), (2, "Compute 12 + 34 - 56"), (3, "北京是哪个国家的首都，它有多少人口？"), (4, "Compute 9+16"),
        (5, "Which of these rivers flows north"), (6, "Alice Bob Carol 1 2 3 Dave Erin Frank 4 5 6"), (7, "In which year did the war end"), (8, "日本の首都"),
    ]
    texts = ["so What is 12 times 7? yes", "what is 12 times 8?", "now compute 12 + 34 - 56.", "compute 12 - 34 + 56", "他问：北京是哪个国家的首都，它有多少人口？谢谢", "北京是哪个城市", "please compute 9+16!",
        "we ask Which of these rivers flows north now", "we ask Where of these rivers flows north now", "x Alice Bob Carol 1 2 3 Dave Erin Frank 4 5 6", "Alice Bob Carol 1 2 3 Dave Erin Frank 4 5 7", "page 12 In which year did the war end", "これは日本の首都です"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: list(r.items) for r in decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [[1], [], [2], [], [3], [], [4], [5], [], [6], [], [7], [8]]


def test_joining_against_every_window_and_place(spark):
    rng = random.Random(4)
    said = FILLER + ["Alice", "Bob", "km", "miles", "12", "7", "three", "hours", "Paris"]
    line = lambda n: " ".join(rng.choice(said) for _ in range(n))
    items = [(k, line(rng.choice([3, 6, 9, 14, 25]))) for k in range(40)] + [(90, items_text := line(12)), (91, items_text), (92, "北京是哪个国家的首都它有多少人口和面积呢")]
    texts = []
    for _ in range(150):
        one = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            one[rng.randrange(len(one))] = rng.choice(said)
        texts.append(" ".join([line(rng.randint(0, 12)), *one[rng.choice([0, 0, 2]) :], rng.choice([". ", " "]) + line(rng.randint(0, 12))]))
    texts += [None, "", "x" * 3000, "问：" + items[-1][1] + "。", texts[0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, t1 string").repartition(3)
    got = {r.id: list(r.items) for r in decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain(texts, items)
    assert sum(map(len, want)) > 60
    assert [got[i] for i in range(len(texts))] == want
    left = decontam.without_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [i for i, x in enumerate(want) if not x]


def test_words_of_letters_are_read_as_all_others():
    """A word in quotes takes the long way and is the same word."""
    for w in "the Alice ALICE aLice km Km three Three n N é Élan ŷ ß ǅa İx Ünï s half Ⅷ ª".split():
        words = decontam.Words()
        a, b = words[w], words['"' + w]
        assert words.text[a] == words.text[b]
        for name in ("code", "exact", "kind", "capital", "unit", "ends"):
            assert getattr(words, name)[a] == getattr(words, name)[b], (w, name)


def test_words_that_are_forgotten_come_back_the_same(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Alice", "12", "km", "w%d" % rng.randint(0, 60), "北京", "W%d." % rng.randint(0, 60)]) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    whole, few = decontam.Words(), None
    monkeypatch.setattr(decontam, "REMEMBERED", 10)
    few = decontam.Words()
    for text in texts:
        a, b = (w.template(w.numbers(text)) for w in (whole, few))
        assert [x.tolist() for x in a[:2]] == [x.tolist() for x in b[:2]]
        assert [whole.text[i] for i in a[2]] == [few.text[i] for i in b[2]]
        assert len(few) <= 10 + len(text.split()) * 3
