"""Vectors for wire messages, checksums, URIs, policies, codecs, sweeps and rules."""

from __future__ import annotations

import gzip
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import codecs, expr, policy, uri, wire
from spanloom.operators import columns, reads, store, sweep, tables


def test_golden_bytes():
    assert wire.encode_concat([{"source": 0, "offset": 0, "length": 0}]) == b"\x0a\x00"
    assert wire.varint(-1) == b"\xff" * 9 + b"\x01"
    assert wire.crc32c_of(b"123456789") == 0xE3069283 and wire.crc32c_of(b"") == 0
    assert wire.crc32c_of(b"ab" * 999) == wire.crc32c_of(b"b" + b"ab" * 998, wire.crc32c_of(b"a"))
    parts = [{"source": 7, "offset": (1 << 64) - 1, "length": 300, "data": None, "crc32c": None}, {"source": 0, "offset": 0, "length": 0, "data": b"x", "crc32c": 0}]
    assert wire.decode_concat(wire.encode_concat(parts)) == parts
    for bad in (b"\x0a\x05", b"\xff" * 11, b"\x00\x00"):
        with pytest.raises(ValueError):
            wire.decode_concat(bad)
    source = {"url": "file:///a", "key": None, "data": None, "size": 0, "etag": '"e"', "modified_not_after": -5}
    assert wire.decode_sources(wire.encode_sources([source])) == [source]


def test_wire_columns(spark):
    two, three = Decimal(2), Decimal(3)
    df = spark.createDataFrame([([(1, two, three, None, None)],), ([],), (None,)], "parts array<struct<source: long, offset: decimal(20,0), length: decimal(20,0), data: binary, crc32c: long>>")
    got = df.select(wire.concat_ranges(wire.concat_payload("parts")).alias("p"), wire.crc32c(F.lit(b"123456789")).alias("c")).collect()
    assert got[0].p[0].source == 1 and got[1].p == [] and got[2].p is None and got[0].c == 0xE3069283
    sizes = spark.range(1).select(*(wire.varint_size(F.lit(n).cast("decimal(20,0)")).alias(str(n)) for n in (0, 127, 128, (1 << 63) - 1))).first()
    assert list(sizes) == [1, 1, 2, 9]


def test_references():
    # RFC 3986, section 5.4
    base = "http://a/b/c/d;p?q"
    for ref, want in {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
                      ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
                      "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x"}.items():
        assert uri.resolve(base, ref) == want, ref
    assert uri.percent_encode("a b/é", "/") == "a%20b/%C3%A9"


def test_uri_and_policy_columns(spark):
    rows = ["a/b", "http://h/x?y#z", "a b", "%zz", "1:b", "a:b", "", "é", "./1:b"]
    got = spark.createDataFrame([(r,) for r in rows], "u string").select(uri.is_reference(F.col("u")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, False, False, False, True, True, False, True]
    refs = {"http://[::1]:80/": True, "http://[1:2:3:4:5:6:7:8]/": True, "http://[1:2:3:4:5:6:7:8:9]/": False, "http://[1::8]/x": True, "http://[::ffff:1.2.3.4]": True, "http://[::1.2.3.400]": False, "http://[v7.a:b]/": True, "http://[::1/": False, "http://h:8a/": False, "//h/x": True,
            "/a//b": True, "http:///x": True, "mailto:a@b.c": True, "a/b:c": True, "a:b:c": True, "x?y=[1]": False, "x#a#b": False, "http://u:p@h:/": True, "http://a@b@c/": False, ":a": False, "urn:x:y": True, "http://[1:2:3::4:5:6:7:8]/": False, "http://[1:2:3:4:5:6:7::]/": True, "a\\b": False}
    got = spark.createDataFrame([(r,) for r in refs], "u string").select("u", uri.is_reference(F.col("u")).alias("ok")).collect()
    assert {r.u: r.ok for r in got} == refs
    hosts = {"127.0.0.1": "loopback", "10.0.0.1": "private", "100.64.0.1": "special", "[::1]": "loopback", "[::ffff:10.0.0.1]": "private", "[fe80::1]": "link-local", "x.localhost": "loopback", "example.com": None, "01.2.3.4": None, "1.2.3.4.": "public",
             "192.0.2.1": "special", "198.18.0.1": "special", "[::ffff:7f00:1]": "loopback", "[64:ff9b::7f00:1]": "loopback", "[2002:7f00:1::]": "loopback"}
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", policy.host_class(F.col("h")).alias("c")).collect()
    assert {r.h: r.c for r in got} == hosts
    urls = [("http://h/a", True), ("http://h/ab", False), ("http://h/a/b", True), ("http://h/a?x", True), ("http://h/a/%2e%2E/x", False), ("http://h/a?x=%2f", True), ("http://h/a#%2e", True), ("http://h/a/%5C", False)]
    got = spark.createDataFrame(urls, "u string, want boolean").select("want", policy.has_prefix(F.col("u"), F.lit("http://h/a")).alias("ok")).collect()
    assert all(r.want == r.ok for r in got)
    got = spark.createDataFrame([('"a"', True), ('W/"a"', False), ('"a b"', False), ('""', True)], "e string, want boolean").select("want", policy.strong_etag(F.col("e")).alias("ok")).collect()
    assert all(r.want == r.ok for r in got)


def test_codecs():
    a = np.arange(24, dtype=">u2").reshape(2, 3, 4)
    head = b"\0\0\0\3" + b"".join(n.to_bytes(4, "big") for n in a.shape)
    assert (codecs.block(head + a.tobytes(order="F"), "u2", (2, 3, 4), 9) == a).all()
    assert codecs.block(head + a.tobytes(order="F"), "u2", (3, 2, 4), 9)[2, 0, 0] == 9
    raw = bytes(range(32))
    shuffled = np.frombuffer(raw, np.uint8).reshape(-1, 4).T.tobytes()
    assert codecs.decode(zlib.compress(shuffled), [("shuffle", {"size": 4}), ("zlib", {})]) == raw
    assert codecs.decode(gzip.compress(raw), [("gzip", {})]) == raw
    with pytest.raises(ValueError):
        codecs.inflate(zlib.compress(raw) + b"x", 15)
    with pytest.raises(ValueError):
        codecs.inflate(zlib.compress(b"a" * 1000), 15, 10)


def test_cells(spark):
    chunks = spark.createDataFrame([([1, 0], zlib.compress(np.arange(6, dtype="<i4").tobytes()))], "idx array<long>, data binary")
    got = codecs.cells(chunks, "<i4", (2, 3), [("zlib", {})]).collect()
    assert [(list(r.pos), r.value) for r in got][4] == ([3, 1], 4.0)


def test_rules_have_the_languages_truth_tables(spark):
    df = spark.createDataFrame([(1.0, 0.0, None, "s", [1.0, 2.0, 2.0])], "a double, z double, n double, s string, l array<double>")
    for text, want in {"a / z > 5": True, "-a / z < 0": True, "finite(a / z)": False, "z / z == z / z": False, "n == n": False, "n != 1": False, "!n": True, "present(n)": False, "n + 1 ?? 7": 7.0, "n ? 1 : 2": 2.0, "s == 's' && !z": True,
                       "len(l) + sum(l)": 8.0, "distinct(l)": 2.0, "same(l)": 0.0, "same([3, 3])": 3.0, "in(2, l)": True, "in(n, l)": False, "max(l) - min(1, a)": 1.0, "int(l, 1, 2)": True, "int(a / 2, 0, 9)": False, "kind(n)": "absent", "1 + 2 * 3 == 7": True, "at(l, 1)": 2.0, "first(l) == 1": True, "abs(-2)": 2.0}.items():
        assert df.select(expr.compile_(text, df).col.alias("x")).first().x == want, text
    for bad in ("1 +", "f(1)", "x", "1 2", "(1"):
        with pytest.raises(ValueError):
            expr.compile_(bad, df)


def test_finish_takes_first_claimants(spark):
    leaves = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 2), (1, 3, 6, 20), (1, 4, 12, 3), (1, 5, 20, 5)], "space long, id long, start long, len long")
    got = sweep.finish(leaves, spark.createDataFrame([(1, 30)], "space long, size long")).collect()
    assert sorted([(r.kind, r.start, r.len, r.id, r.target) for r in got], key=str) == sorted(
        [("leaf", 0, 10, 1, None), ("alias", 5, 2, 2, 1), ("alias", 6, 20, 3, 1), ("gap", 10, 2, None, None), ("leaf", 12, 3, 4, None), ("gap", 15, 5, None, None), ("leaf", 20, 5, 5, None), ("gap", 25, 5, None, None)], key=str)


def test_wrapping_and_runs(spark):
    v = [0, 2**63 - 1, -(2**63), 5]
    df = spark.createDataFrame([(1, j, x) for j, x in enumerate(v)], "grp long, j long, v long")
    assert [r.v for r in columns.delta_decode(columns.delta_encode(df)).orderBy("j").collect()] == v
    runs = spark.createDataFrame([(1, j, x) for j, x in enumerate([1, 1, 1, 2, 3, 2, 3, 2, 3, 9])], "grp long, j long, v long")
    assert [(r.at, r.period, r.repeats) for r in columns.column_runs(runs).orderBy("at").collect()] == [(0, 1, 3), (3, 2, 3)]


def test_public_object_urls(spark):
    urls = {"s3://b-1/k/x": "https://b-1.s3.amazonaws.com/k/x", "S3://b1": "https://b1.s3.amazonaws.com/", "s3://a.b/k": None, "https://h/x": None, "s3://B1/k": None, "s3://-b/k": None, "s3://b/k": None}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", policy.public_object_url(F.col("u")).alias("x")).collect()
    assert {r.u: r.x for r in got} == urls


def test_address_classes_against_ipaddress(spark):
    import ipaddress
    import random

    rng = random.Random(5)

    def plain(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        if a.version == 6:
            n = int(a)
            if n >> 32 in (0xFFFF, 0x64FF9B << 64):
                return plain(str(ipaddress.IPv4Address(n & 0xFFFFFFFF)))
            if n >> 112 == 0x2002:
                return plain(str(ipaddress.IPv4Address(n >> 80 & 0xFFFFFFFF)))
        return next((c for c, some in policy.CLASSES.items() for b in some if a in ipaddress.ip_network(b)), "public")

    hosts = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)] + [str(ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 0, 64, 96, 120]))) for _ in range(200)]
    for some in policy.CLASSES.values():
        for b in some:
            net = ipaddress.ip_network(b)
            hosts += [str(net[0]), str(net[-1])] + ([str(net[0] - 1)] if int(net[0]) else [])
    groups = lambda n: ":".join(rng.choice(["", "0", "a", "ffff", "1234", "12345", "g", "1.2.3.4"]) for _ in range(n))
    hosts += [groups(rng.randint(1, 10)) for _ in range(1500)] + ["::" + groups(rng.randint(0, 8)) for _ in range(500)] + ["64:ff9b::10.0.0.1", "::1.2.3.4", "2002:a00:1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1::1.2.3.4:5"]
    hosts = sorted({h for h in hosts if not h.endswith(".")})
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", policy.host_class(F.col("h")).alias("c")).collect()
    assert {r.h: r.c for r in got} == {h: plain(h) for h in hosts}


def test_running_values_cross_blocks(spark):
    from spanloom.operators import blocks

    rows = [(g, i * 3 % 200, (i * 7919) % 50) for g in (1, 2) for i in range(150)]
    df = spark.createDataFrame(rows, "g long, at long, v long")
    for how in ("max", "sum", "last"):
        for inclusive in (False, True):
            want = {}
            for g in (1, 2):
                seen = []
                for at, v in sorted((a, v) for h, a, v in rows if h == g):
                    so = seen + [v] if inclusive else seen
                    some = [x for x in so if how != "last" or x % 4]
                    want[g, at, v] = (max(some) if how == "max" else sum(some) if how == "sum" else some[-1]) if some else None
                    seen.append(v)
            value = F.when(F.col("v") % 4 > 0, F.col("v")) if how == "last" else F.col("v")
            for width in (1, 16, 1 << 30):
                got = blocks.running(df, ["g"], "at", ["v"], value, how, "x", inclusive, width).collect()
                assert {(r.g, r.at, r.v): r.x for r in got} == want
    numbers = blocks.numbered(df.select("at", "v").distinct(), [F.desc("v"), "at"], "k", 5).collect()
    assert [(r.at, r.v) for r in sorted(numbers, key=lambda r: r.k)] == sorted({(a, v) for _, a, v in rows}, key=lambda x: (-x[1], x[0]))
    assert sorted(r.k for r in numbers) == list(range(len(numbers)))


def test_empty_leaves_leave_their_place(spark):
    leaves = spark.createDataFrame([(1, 1, 10, 0), (1, 2, 20, 5)], "space long, id long, start long, len long")
    got = sweep.finish(leaves, spark.createDataFrame([(1, 30), (2, 4)], "space long, size long")).collect()
    assert sorted((r.space, r.kind, r.start, r.len) for r in got) == [(1, "gap", 0, 20), (1, "gap", 25, 5), (1, "leaf", 10, 0), (1, "leaf", 20, 5), (2, "gap", 0, 4)]


def test_gaps_at_cuts_are_not_read(spark):
    df = spark.createDataFrame([(1, 0, 100, [(0, 30), (35, 60), (61, 90), (95, 100)])], "source long, start long, stop long, ranges array<struct<start: long, stop: long>>")
    assert sorted((r.start, r.stop) for r in reads.split_pieces(df, 4, 10, 50).collect()) == [(0, 30), (35, 60), (61, 90), (95, 100)]
    assert sorted((r.start, r.stop) for r in reads.split_pieces(df, 3, 10, 50).collect()) == [(0, 30), (35, 60), (61, 90), (95, 100)]
    assert sorted((r.start, r.stop) for r in reads.split_pieces(df, 1, 10, 65).collect()) == [(0, 60), (61, 100)]


def test_splitting_never_cuts_an_asked_range(spark):
    df = spark.createDataFrame([(1, 0, 100, [(0, 30), (30, 60), (60, 90), (90, 100)])], "source long, start long, stop long, ranges array<struct<start: long, stop: long>>")
    assert sorted((r.start, r.stop) for r in reads.split_pieces(df, 4, 10, 50).collect()) == [(0, 30), (30, 60), (60, 90), (90, 100)]
    got = sorted((r.start, r.stop) for r in reads.split_pieces(df, 1, 10, 65).collect())
    assert got == [(0, 60), (60, 100)]


def test_page_look_ups(spark):
    pages = spark.createDataFrame([("b", 0), ("d", 1), ("k", 2)], "first_key string, page long")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("zz",), ("k",), ("d",)], "key string")
    for parts in (1, 3, None):
        got = {r.key: r.page for r in tables.page_of(keys, pages, parts).collect()}
        assert got == {"a": None, "b": 0, "c": 0, "d": 1, "k": 2, "zz": 2}


def test_resolution_of_bytes(spark):
    blob = bytes(range(256)) * 4
    objects = spark.createDataFrame([(0, blob), (1, b"SHARED"), (2, b"short")], "source long, data binary")
    ranges = spark.createDataFrame([("r", 0, 0, 100, 3), ("r", 1, 1, 1, 2), ("x", 0, 2, 3, 9), ("y", 0, 9, 0, 4), ("y", 1, 1, 0, 2)], "key string, part long, source long, offset long, length long")
    got = {r.key: (r.value, r.error) for r in store.resolve(store.pieces(ranges, "offset", 0), objects).collect()}
    assert got["r"] == (b"defHA", None) and got["x"][1] == "resolution: part 0" and got["y"][1] == "resolution: part 0"
    got = {r.key: (bytes(r.value), r.error) for r in store.resolve(store.pieces(ranges, "suffix", 2), objects).where("error is null").collect()}
    assert got["y"] == (b"SH", None)  # the part outside of the window is never looked up
    with pytest.raises(ValueError):
        store.pieces(ranges, "range", 5, 2)
