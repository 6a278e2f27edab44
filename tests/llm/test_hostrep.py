from __future__ import annotations

from spanloom.llm import hostrep


def judge(spark, pages, labels):
    p = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' as host", "1 as n")
    return {r.page_id: r for r in hostrep.judge(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}


def test_rules_and_parsing(spark):
    pages = [(1, "http://A.Example.COM/en/x?q"), (2, "https://www.example.com/en/1#f"), (3, "http://x.net/es/"), (4, "http://x.net/fr"), (5, None), (6, "no scheme"), (7, "a://b://c/d"), (8, "http://com/"), (9, "http://notexample.com/en/"), (10, "http://exampleXcom/en/"), (11, "http://Ünet/es/a"), (12, "http://É.net/fr/\nx")]
    got = judge(spark, pages, [])
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 13)] == [
        ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("x.net", "/es/", "net/es/", "block"), ("x.net", "/fr", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("com", "/", "com/", "allow"), ("notexample.com", "/en/", "com/", "allow"), ("exampleXcom".lower(), "/en/", None, "allow"),
        ("Ünet", "/es/a", None, "allow"), ("É.net", "/fr/\nx", "net/fr/", "block"),
    ]


def test_posterior_shrinks_to_domain_and_blocks_bad_hosts(spark):
    pages, labels = [], []
    for k in range(300):
        host = ["bad.a.org", "good.a.org", "x.b.org"][k % 3]
        pages.append((k, f"http://{host}/en/{k}"))
        labels.append((k, 1, int(k % 3 == 0)))
    pages += [(900, "http://new.a.org/q"), (901, "http://new.b.org/q"), (902, "http://elsewhere.io/")]
    labels += [(5000, 0, 1), (1, None, None), (None, 0, 1)]
    got = judge(spark, pages, labels)
    assert got[0].verdict == "block" and got[1].verdict == "allow" and got[2].verdict == "allow"
    assert got[2].bad_rate < got[901].bad_rate < got[900].bad_rate < got[0].bad_rate
    assert 0 < got[902].bad_rate < 1 and got[902].verdict == "allow"


def test_empty_tables(spark):
    assert judge(spark, [(1, "http://h.org/1")], [])[1].verdict == "allow"
    assert judge(spark, [], [(1, 1, 1)]) == {}
