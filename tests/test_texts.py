"""Names, numbers, dates, units and texts against plain Python."""

from __future__ import annotations

import datetime
import math
import random
import uuid

from pyspark.sql import functions as F

from spanloom.functions import texts


def one(spark, rows, schema, col):
    return [r.x for r in spark.createDataFrame(rows, schema).repartition(1).select(col.alias("x")).collect()]


def test_key_names_come_back(spark):
    want = {"0": ("", 0), "a.12": ("a.", 12), "007": ("00", 7), "x": ("x", texts.NO_INDEX), "18446744073709551614": ("", (1 << 64) - 2), "18446744073709551615": ("18446744073709551615", texts.NO_INDEX), "a~b%/": ("a%7Eb%25%2F~", 0), "99999999999999999999999": ("99999999999999999999999", texts.NO_INDEX), "": ("", texts.NO_INDEX), "c0": ("c", 0)}
    got = one(spark, [(k,) for k in want], "s string", texts.key_name(F.col("s"), F.lit(False)))
    assert [(r.name, int(r.idx)) for r in got] == [*want.values()]
    name = texts.key_name(F.col("s"), F.lit(False))
    assert one(spark, [(k,) for k in want], "s string", texts.key_segment(name["name"], name["idx"])) == [*want]
    shadowed = texts.key_name(F.col("s"), F.lit(True))
    assert [(r.name, int(r.idx)) for r in one(spark, [("a1",)], "s string", shadowed)] == [("a1~", 1)]
    assert one(spark, [("a1",), ("~%2F",)], "s string", texts.key_segment(shadowed["name"], shadowed["idx"])) == ["a1", "~%2F"]


def test_source_names(spark):
    rows = [(1, k, t) for k, t in enumerate(["a", "b/c", "a", "", "fixed", "a", "x~"])] + [(2, 0, "a")]
    got = texts.source_names(spark.createDataFrame(rows, "parent long, pos long, text string"), ("fixed",))
    back = {(r.parent, r.pos): (r.name, int(r.idx), r.back) for r in got.withColumn("back", texts.source_text(F.col("name"), F.col("idx"))).collect()}
    none = texts.NO_INDEX
    assert back == {(1, 0): ("a", none, "a"), (1, 1): ("b%2Fc~", 0, "b/c"), (1, 2): ("a~", 1, "a"), (1, 3): ("~", 0, ""), (1, 4): ("fixed~", 0, "fixed"), (1, 5): ("a~", 2, "a"), (1, 6): ("x%7E~", 0, "x~"), (2, 0): ("a", none, "a")}


def test_object_keys(spark):
    want = {"a/b": "a/b", "a/zarr.json": "a/zarr.json~", ".zarray~~": ".zarray~~~", "zarr.json/x": "zarr.json/x", "x.zgroup": "x.zgroup"}
    assert one(spark, [(k,) for k in want], "k string", texts.object_key(F.col("k"), "others/")) == ["others/" + v for v in want.values()]


def test_numbers_and_texts_of_bytes(spark):
    rng = random.Random(3)
    rows = [(bytes(rng.randrange(256) for _ in range(rng.randint(1, 8))),) for _ in range(60)] + [(b"\xff" * 8,), (b"\0" * 8,)]
    for little in (True, False):
        for signed in (True, False):
            got = one(spark, rows, "b binary", texts.integer(F.col("b"), little, signed))
            assert [int(x) for x in got] == [int.from_bytes(b, "little" if little else "big", signed=signed) for (b,) in rows]
    ids = [(uuid.UUID(int=rng.getrandbits(128)).bytes_le,) for _ in range(20)]
    assert one(spark, ids, "b binary", texts.guid(F.col("b"))) == [str(uuid.UUID(bytes_le=b)) for (b,) in ids]
    assert one(spark, [(b"caf\xe9\0rest",)], "b binary", texts.cstr(F.col("b"))) == ["café"]
    assert one(spark, [("né😀".encode("utf-16-le"),)], "b binary", texts.utf16(F.col("b"))) == ["né😀"]


def test_dates(spark):
    good = {"Sun, 06 Nov 1994 08:49:37 GMT": 784111777, "Thu, 01 Jan 1970 00:00:00 GMT": 0, "Sat, 31 Dec 2016 23:59:60 GMT": 1483228800, "Tue, 29 Feb 2000 12:00:00 GMT": 951825600}
    bad = ["Mon, 06 Nov 1994 08:49:37 GMT", "Sun, 6 Nov 1994 08:49:37 GMT", "Sun, 06 Nov 1994 24:49:37 GMT", "Thu, 30 Feb 2000 12:00:00 GMT", "Sun, 06 nov 1994 08:49:37 GMT", "", "Sun, 06 Nov 1994 08:49:61 GMT"]
    assert one(spark, [(t,) for t in [*good, *bad]], "t string", texts.imf_fixdate(F.col("t"))) == [*good.values()] + [None] * len(bad)
    rng = random.Random(5)
    seconds = [rng.randrange(0, 4_000_000_000) for _ in range(50)]
    shown = one(spark, [(s,) for s in seconds], "s long", texts.to_imf_fixdate(F.col("s")))
    assert shown == [datetime.datetime.fromtimestamp(s, datetime.UTC).strftime("%a, %d %b %Y %H:%M:%S GMT") for s in seconds]
    assert one(spark, [(t,) for t in shown], "t string", texts.imf_fixdate(F.col("t"))) == seconds
    points = {"1994-11-06 08:49:37": (784111777, 0.0), "1994-11-06 08:49:37.25": (784111777, 0.25), "1994-02-29 08:49:37": None, "1994-11-06 08:49:60": None, "1994-11-06 08:49:37.": None, "1994-11-06T08:49:37": None}
    got = one(spark, [(t,) for t in points], "t string", texts.time_point(F.col("t")))
    assert [r and (r.seconds, r.fraction) for r in got] == [*points.values()]


def test_units_and_places(spark):
    assert one(spark, [("Å",), ("um",), ("xy",)], "s string", texts.unit(F.col("s"))) == ["angstrom", "micrometer", None]
    assert one(spark, [(2.0, "inch", "millimeter"), (1.0, "second", "meter")], "v double, a string, b string", texts.length_in(F.col("v"), F.col("a"), F.col("b"))) == [2.0 * (0.0254 / 1e-3), None]
    assert one(spark, [(10.0, 8, 0.5)], "c double, n long, s double", texts.centred(F.col("c"), F.col("n"), F.col("s"))) == [8.0]
    assert one(spark, [(1.0, 0.5, 0.0)], "r double, g double, b double", texts.colour(F.col("r"), F.col("g"), F.col("b"))) == ["FF8000"]
    rng = random.Random(7)
    lists = [([rng.randrange(1, 1 << 40) * 6 for _ in range(rng.randint(1, 4))],) for _ in range(20)] + [([],), ([0, 12],), ([-9, 6],), ([(1 << 62), 3],)]
    assert one(spark, lists, "l array<long>", texts.greatest_divisor(F.col("l"))) == [math.gcd(*x) for (x,) in lists]


def test_fnv1a(spark):
    def plain(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    rows = [(b"",), (b"a",), (b"foobar",), (bytes(range(256)),)]
    assert one(spark, rows, "b binary", texts.fnv1a(F.col("b"))) == [plain(b) for (b,) in rows]
