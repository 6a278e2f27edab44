from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import codecs
from spanloom.functions.strict_json import Rejected, parse
from spanloom.sources import arrays, sniff
from spanloom.streaming import listing

N5 = {"dimensions": [5, 4], "blockSize": [2, 4], "dataType": "uint16", "compression": {"type": "gzip", "level": -1}}
ZARR = {"zarr_format": 2, "shape": [3, 5], "chunks": [2, 2], "dtype": ">i4", "order": "F", "compressor": {"id": "zlib"}, "filters": None, "fill_value": -7}


def test_documents_are_strict():
    assert parse(b'{"a": [1, 2.0, "\\u00e9"]}') == {"a": [1, 2.0, "é"]}
    for bad in (b"", b"\xef\xbb\xbf{}", b"NaN", b"[1,]", b"{} x", b"\xff", b'{"a":1,"a":2}', b"[" * 257 + b"]" * 257):
        with pytest.raises(Rejected):
            parse(bad)


def test_array_documents():
    got = arrays.n5_array(N5)
    assert got["shape"] == [5, 4] and got["codecs"][0]["configuration"]["codecs"] == [
        {"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 6}}]
    got = arrays.zarr2_array(ZARR)
    assert got["fill_value"] == -7 and [c["name"] for c in got["codecs"]] == ["transpose", "bytes", "zlib"] and got["codecs"][2]["configuration"] == {"level": 1}
    assert arrays.zarr2_array(ZARR | {"dtype": "<f4", "fill_value": -0.0})["fill_value"] == "0x80000000"
    for change in ({"dimensions": []}, {"dimensions": [5]}, {"blockSize": [0, 1]}, {"dataType": "string"}, {"compression": {"type": "lz4"}}, {"compression": {"type": "gzip", "level": 10}}, {"compression": {"type": "gzip", "useZlib": 1}}, {"dimensions": [5.5, 1]}):
        with pytest.raises(Rejected):
            arrays.n5_array(N5 | change)
    for change in ({"zarr_format": 3}, {"dtype": "|i4"}, {"dtype": "<M8"}, {"dtype": "<c8"}, {"order": "A"}, {"filters": [1]}, {"fill_value": 2**31}, {"dimension_separator": "-"}, {"compressor": {"id": "lz4"}}, {"chunks": [2]}):
        with pytest.raises(Rejected):
            arrays.zarr2_array(ZARR | change)


def test_n5_store(spark):
    keys = {"attributes.json": b"{}", "a/b/attributes.json": json.dumps(N5).encode(), "a/b/0/0": b"x", "a/b/2/0": b"x", "a/b/3/0": b"x", "a/b/00/0": b"x", "a/b/1/0": b"", "a/b/0/0/attributes.json": b"broken", "a/c/attributes.json": b"[]", "z/y": b"q", "a//x": b"", "d/": b""}
    rows = spark.createDataFrame(list(keys.items()), "key string, data binary")
    objects = rows.select("key", F.octet_length("data").cast("long").alias("size"))
    entries, chunks, others = arrays.virtualize(objects, rows.where("endswith(key, 'attributes.json')"), "n5")
    got = {r.key: r for r in entries.collect()}
    assert sorted(got) == ["a/b/zarr.json", "a/c/zarr.json", "a/zarr.json", "zarr.json"] and got["a/c/zarr.json"].reject
    assert sorted((r.key, list(r["index"])) for r in chunks.collect()) == [("a/b/0/0", [0, 0]), ("a/b/2/0", [2, 0])]
    assert {"z/y", "a/b/3/0", "a/b/00/0", "a/b/1/0"} <= {r.key for r in others.collect()}
    assert arrays.choose_profile(objects).first().profile == "n5"


def test_zarr_store_to_cells(spark):
    import zlib

    full = np.arange(15).reshape(3, 5)
    keys = {".zgroup": b'{"zarr_format": 2}', "x/.zarray": json.dumps(ZARR | {"dtype": "<i4", "order": "C", "chunks": [2, 5]}).encode()}
    for i in range(2):
        block = np.full((2, 5), -7, "<i4")
        block[: len(full[2 * i : 2 * i + 2])] = full[2 * i : 2 * i + 2]
        keys[f"x/{i}.0"] = zlib.compress(block.tobytes())
    rows = spark.createDataFrame(list(keys.items()), "key string, data binary")
    objects = rows.select("key", F.octet_length("data").cast("long").alias("size"))
    _, chunks, _ = arrays.virtualize(objects, rows.where("key like '%.z%'"), "zarr2")
    data = chunks.join(rows, "key").select(F.col("index").alias("idx"), "data")
    got = codecs.cells(data, "<i4", (2, 5), [("zlib", {})]).where("pos[0] < 3").collect()
    assert {tuple(r.pos): r.value for r in got} == {(i, j): float(full[i, j]) for i in range(3) for j in range(5)}


def test_sniffing_and_nifti(spark):
    head = bytearray(552)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 4, 5, 2, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<8f", head, 76, 1, 0.5, 0.5, 2, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    head[344:348] = b"n+1\0"
    dicom = bytes(128) + b"DICM"
    files = spark.createDataFrame([("a", bytes(head)), ("b", dicom), ("c", b"II*\0"), ("d", b"zz"), ("e", bytes(head[:300]))], "url string, head binary")
    got = {r.url: r.f for r in files.select("url", sniff.format_of(F.col("head")).alias("f")).collect()}
    assert got == {"a": "nifti", "b": "dicom", "c": "tiff", "d": None, "e": None}
    headers = sniff.nifti(files.where("url in ('a', 'e')"))
    rows = {r.url: r for r in headers.collect()}
    assert rows["a"].shape == [4, 5, 2] and rows["a"].dtype == "int16" and rows["a"].scale == [0.5, 0.5, 2.0] and rows["e"].reject == "header: cut off"
    assert sorted((r["index"], r.offset, r.length) for r in sniff.nifti_planes(headers).collect()) == [(0, 352, 40), (1, 392, 40)]


def test_listing_stream(spark, tmp_path):
    rows = [("a/b/1", 5, "2024-01-01 00:00:01"), ("a/b/1", 5, "2024-01-01 00:00:02"), ("a//x", 1, "2024-01-01 00:00:03"), ("a/c", 7, "2024-01-01 00:11:00")]
    spark.createDataFrame(rows, "key string, size long, seen string").selectExpr("key", "size", "timestamp(seen) as seen").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, size long, seen timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("fresh", listing.new_objects(stream), "append"), ("below", listing.directory_sizes(stream), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.key for r in spark.table("fresh").collect()) == ["a/b/1", "a/c"]
    assert sum(r.bytes for r in spark.table("below").where("dir = 'a/b'").collect()) == 10
