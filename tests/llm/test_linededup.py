from __future__ import annotations

import random

from spanloom.llm import linededup


def plain(rows, min_chars=24):
    """id -> removed line numbers, by comparing all pairs of lines."""
    where = {}
    for i, t in rows:
        if i is not None and t is not None:
            for k, line in enumerate(t.split("\n")):
                n = " ".join(line.lower().split())
                if len(n) >= min_chars:
                    where.setdefault(n, []).append((i, k))
    keys = list(where)
    sets = [{n[j : j + 8] for j in range(len(n) - 7)} for n in keys]
    root = list(range(len(keys)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    first = {}
    for k, n in enumerate(keys):
        first[top(k)] = min(first.get(top(k), (9**9, 0)), *where[n], (9**9, 0))
    out = {}
    for k, n in enumerate(keys):
        for i, line in where[n]:
            if (i, line) != first[top(k)]:
                out.setdefault(i, set()).add(line)
    return {i: sorted(x) for i, x in out.items()}


def test_lines_against_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    base = [[word() for _ in range(rng.randint(4, 60))] for _ in range(60)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                line[rng.randrange(len(line))] = word()
            lines.append(rng.choice(["", "  "]) + " ".join(line).capitalize())
        rows.append((i, "\n".join(lines)))
    rows += [(300, None), (301, ""), (302, "\n\n\n"), (303, "short line\nshort line"), (304, rows[5][1]), (304, rows[5][1]), (None, rows[6][1]), (305, "y" * 30000 + "\n" + "y" * 29000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'h' as h", "1 as line", "2 as removed").repartition(4)
    gone = linededup.removals(docs)
    want = plain(rows)
    assert {r.id: r.removed for r in gone.collect()} == want
    left = {(r.doc_id): r.text for r in linededup.without_lines(docs.drop("removed"), gone).collect()}
    for i, t in rows[:120]:
        cut = want.get(i, [])
        kept = [x for k, x in enumerate(t.split("\n")) if k not in cut]
        assert left[i] == ("\n".join(kept) if kept else None)
    assert linededup.removals(docs.where("false")).count() == 0


def test_blocks_of_a_bucket_lose_no_link(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    family, norms = [word() for _ in range(30)], []
    for _ in range(60):
        line = list(family)
        for _ in range(rng.randint(0, 5)):
            line[rng.randrange(30)] = word()
        norms.append(" ".join(line))
    norms = sorted(set(norms))
    close = [(a, b) for a in range(len(norms)) for b in range(a) if len(linededup.shingles(norms[a]) & linededup.shingles(norms[b])) >= 0.8 * len(linededup.shingles(norms[a]) | linededup.shingles(norms[b]))]

    def groups(links):
        root = list(range(len(norms)))
        for a, b in links:
            a, b = root[a], root[b]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    assert groups(linededup.linked(norms, linededup.shingle_maps(norms))) == groups(close) and len(set(groups(close))) > 1
    members = spark.createDataFrame([(1, k) for k in range(len(norms))], "key long, h long")
    texts = spark.createDataFrame(list(enumerate(norms)), "h long, norm string")
    for block in (7, 1000):
        assert groups([(r.u, r.v) for r in linededup.links(members, texts, block).collect()]) == groups(close)


def test_query_removes_short_lines_and_date_variants(spark, tmp_path):
    from spanloom.llm import queries

    texts = [
        "All rights reserved.\nOk\n\ncopyright 2019 the example authors, all rights reserved", "all  rights reserved.\nok\n\ncopyright 2020 the example authors, all rights reserved",
        "All rights removed!\nno", "the quick brown fox jumps over it", "the quick brown fax jumps over it",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.removed for r in queries.op10_linededup(spark, str(tmp_path)).collect()} == {0: "", 1: "0,1,3", 2: "", 3: "", 4: "0"}


def test_lines_are_normalised_alike():
    rng = random.Random(6)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\x85", "\x1c", "ΑΣ", "Σ", "İ", "ß", "\r\n", "x y", "\u2028", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)] + ["plain text\nof two lines ", "", "\n"]
    for text in texts:
        assert linededup.normals(text) == [linededup.normal(line) for line in text.split("\n")], text


def test_minima_agree_as_often_as_lines_are_similar():
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh ") for _ in range(60))
    pairs = [(a[:k] + "X" + a[k + 1 :], linededup.shingles(a, 3)) for k in range(3, 57, 6)]
    n = 5000
    minima = lambda norms, size, n: linededup.minima(*linededup.shingle_hashes(norms, size), n)
    own = minima([a], 3, n)
    for other, mine in pairs:
        theirs = linededup.shingles(other, 3)
        want = len(mine & theirs) / len(mine | theirs)
        assert abs((minima(["zzzzzz", other], 3, n)[1:] == own).mean() - want) < 0.06
    assert (minima([a, "x" * 3], 3, 280) != linededup._NONE).all()


def test_sets_as_integers_and_maps_tell_what_plain_sets_tell():
    rng = random.Random(4)
    lines = []
    for letters in ("abcdefgh ", "aeéÿ ", "aé北Σ ", "ab"):
        for _ in range(12):
            line = "".join(rng.choice(letters) for _ in range(rng.choice([8, 9, 40, 300])))
            lines += [line, line[: len(line) // 2] + "x" + line[len(line) // 2 :], line[:-1] + "京", line.replace("a", "b", rng.randint(0, 3))]
    lines += ["y" * 3000, "y" * 2000 + "z" * 9, "12345678", "1234567\xff", "1234567\u0100", "\ud800" * 9]
    for size in (linededup.SHINGLE, linededup.FINE):
        plain_sets, own, maps = [linededup.shingles(x, size) for x in lines], [linededup.distinct_of(x, size) for x in lines], linededup.shingle_maps(lines, size)
        assert [len(x) for x in own] == [len(x) for x in plain_sets]
        together = 0
        for x, a in enumerate(plain_sets):
            for y, b in enumerate(plain_sets):
                want = len(a & b) >= 0.8 * len(a | b)
                assert linededup.alike_lines(lines[x], lines[y], own[x], own[y], size) == want
                assert (maps[x] ^ maps[y]).bit_count() <= len(a ^ b)
                together += want
            near = linededup.compared([lines[x]] * len(lines), lines, size)
            assert {y for y, b in enumerate(plain_sets) if len(a & b) >= 0.8 * len(a | b)} <= set(near)
        assert together > len(lines)
    # lines of similarity 0.4 need no comparison of sets
    base = ["".join(rng.choice("abcdefghij ") for _ in range(300)) for _ in range(50)]
    other = [x[:40] + "".join(rng.choice("klmnopqrst ") for _ in range(120)) + x[160:] for x in base]
    assert linededup.compared(base, other, 8) == [] and linededup.compared(base, base, 8) == list(range(50))
