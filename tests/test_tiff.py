from __future__ import annotations

import struct

import pytest

from spanloom.sources import save, tiff


def build(end="<", big=False, jpeg=False):
    """One directory of 2 x 2 tiles of 16 x 16 in an image of 30 x 20, with a SubIFD of one strip."""
    out = bytearray()
    word = "Q" if big else "I"
    out += (b"II" if end == "<" else b"MM") + (struct.pack(end + "HHHQ", 43, 8, 0, 0) if big else struct.pack(end + "HI", 42, 0))
    places = [len(out) + 10 * k for k in range(4)]
    out += b"0123456789" * 4
    tables = b"\xff\xd8TABLES\xff\xd9"

    def directory(entries, after=0):
        nonlocal out
        body = b""
        later = []
        for tag, kind, values in sorted(entries):
            size = struct.calcsize(end + tiff.FIELD[kind][1])
            raw = values if kind == 7 else struct.pack(end + tiff.FIELD[kind][1] * len(values), *values)
            n = len(values)
            room = struct.calcsize(end + word)
            if len(raw) > room:
                later.append((tag, raw))
                raw = struct.pack(end + word, len(out))
                out += later[-1][1]
            body += struct.pack(end + "HH" + word, tag, kind, n) + raw.ljust(room, b"\0")
            assert size
        at = len(out)
        out += struct.pack(end + ("Q" if big else "H"), len(entries)) + body + struct.pack(end + word, after)
        return at

    sub = directory([(256, 3, [8]), (257, 3, [5]), (273, 4, [places[0]]), (278, 3, [99]), (279, 4, [7])])
    main = [(256, 3, [30]), (257, 3, [20]), (259, 3, [7 if jpeg else 1]), (322, 3, [16]), (323, 3, [16]), (324, 4, places), (325, 4, [10, 10, 0, 10]), (330, 4, [sub])]
    if jpeg:
        main.append((347, 7, tables))
    first = directory(main)
    struct.pack_into(end + word, out, 8 if big else 4, first)
    return bytes(out), places


@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_directories_and_tiles(end, big):
    data, places = build(end, big)
    got = tiff.tiles_of(data)
    assert [(t[0], t[1], t[9], t[10], t[11], t[12]) for t in got] == [(0, None, 0, 0, places[0], 10), (0, None, 0, 1, places[1], 10), (0, None, 1, 1, places[3], 10), (1, 0, 0, 0, places[0], 7)]
    for bad in (data[:7], b"XX" + data[2:], data[: len(data) - 9]):
        with pytest.raises(tiff.Malformed):
            tiff.tiles_of(bad)


def test_pyramid_compares_with_the_last_taken():
    assert tiff.pyramid([(100, 80), (50, 80), (60, 40), (55, 45), (30, 20), (30, 10)]) == [0, 2, 4]


def test_recipes_and_archive(spark, tmp_path):
    data, places = build(jpeg=True)
    chunks = tiff.tiles(spark.createDataFrame([("f", data), ("g", b"no")], "url string, data binary"))
    assert [r.reject for r in chunks.where("url = 'g'").collect()] == ["header"]
    rows = tiff.recipes(chunks).where("ifd = 0 and row = 0 and col = 1").orderBy("part").collect()
    assert [(r.offset, r.length, r.data) for r in rows] == [(places[1], 2, None), (None, None, b"TABLES"), (places[1] + 2, 8, None)]
    manifest = spark.createDataFrame([("a", [0, 1], "u", 5, 7), ("a", [1, 0], "v", 0, 3), ("b", [0], "v", 3, 3), ("b", [1], "v", 3, 0)], "array string, chunk_idx array<long>, url string, offset long, length long")
    sources, ranges = save.from_manifest(manifest)
    assert {r.url: r.idx for r in sources.collect()} == {"v": 0, "u": 1}
    entries = spark.createDataFrame([("zarr.json", b"{}")], "key string, bytes binary")
    assert save.faults(entries, ranges, sources).count() == 0
    path = str(tmp_path / "s.zip")
    save.save(path, sources.drop("n"), entries, ranges)
    from spanloom.sources import archive

    archive.register(spark)
    got = {r.key: r for r in spark.read.format("spanarchive").load(path).where("not hidden").collect()}
    assert sorted(got) == ["a/c/0/1", "a/c/1/0", "b/c/0", "zarr.json"]
