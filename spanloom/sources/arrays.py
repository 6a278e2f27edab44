"""Chunked array stores (N5, Zarr v2) as hierarchies of references, from a listing and its documents.

objects (key, size) is a listing, documents (key, data) holds the metadata objects among them.  No chunk is read.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strict_json import Rejected, integer, integers, parse
from ..operators.prefixes import ancestors, ignored, implied_groups, nearest_ancestor

# fixed values: data types and their sizes, compressors of blosc, and ranges of levels with their defaults
SIZES = {"bool": 1, "int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "float16": 2, "int32": 4, "uint32": 4, "float32": 4, "int64": 8, "uint64": 8, "float64": 8}
N5_TYPES = tuple(t for t in SIZES if t not in ("bool", "float16"))
BLOSC = ("blosclz", "lz4", "lz4hc", "snappy", "zlib", "zstd")
N5_LEVELS = {"gzip": (-1, 9, 6), "zstd": (-131072, 22, 3)}
ZARR_LEVELS = {"zlib": (-1, 9, 1), "gzip": (-1, 9, 1), "zstd": (-131072, 22, 0)}
KINDS = {"b": "bool", "i": "int", "u": "uint", "f": "float"}
LARGEST = {"float16": 65504.0, "float32": 3.4028234663852886e38}
NEGATIVE_ZERO = {"float16": "0x8000", "float32": "0x80000000", "float64": "0x8000000000000000"}


def _level(compressor: dict, name: str, bounds: dict) -> int:
    lo, hi, default = bounds[name]
    level = integer(compressor.get("level", default), lo, hi, "level")
    return 6 if level == -1 and name != "zstd" else level


def _blosc(compressor: dict, size: int, lowest: int) -> dict:
    if compressor.get("cname") not in BLOSC:
        raise Rejected("blosc: cname")
    shuffle = integer(compressor.get("shuffle"), lowest, 2, "shuffle")
    name = ("noshuffle", "shuffle", "bitshuffle")[shuffle if shuffle >= 0 else 2 if size == 1 else 1]
    return {"name": "blosc", "configuration": {"cname": compressor["cname"], "clevel": integer(compressor.get("clevel"), 0, 9, "clevel"), "shuffle": name, "typesize": size, "blocksize": integer(compressor.get("blocksize", 0), 0, 2**31 - 1, "blocksize")}}


def _document(shape, dtype, chunks, separator, fill, codecs) -> dict:
    return {
        "zarr_format": 3, "node_type": "array", "shape": shape, "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}},
        "chunk_key_encoding": {"name": "v2", "configuration": {"separator": separator}}, "fill_value": fill, "codecs": codecs, "attributes": {},
    }


def _reversal(n: int) -> dict:
    return {"name": "transpose", "configuration": {"order": list(range(n))[::-1]}}


def n5_array(doc: dict) -> dict:
    """The array document of an N5 dataset."""
    shape = integers(doc.get("dimensions"), 0, 2**53 - 1, "dimensions")
    chunks = integers(doc.get("blockSize"), 1, 2**31 - 1, "blockSize")
    if not 1 <= len(shape) <= 32 or len(chunks) != len(shape):
        raise Rejected("dimensions and blockSize")
    dtype = doc.get("dataType")
    if dtype not in N5_TYPES:
        raise Rejected(f"dataType: {dtype!r}")
    compression = doc["compression"] if "compression" in doc else {"type": doc.get("compressionType")}
    kind = compression.get("type") if isinstance(compression, dict) else None
    size = SIZES[dtype]
    inner = [_reversal(len(shape)), {"name": "bytes"} if size == 1 else {"name": "bytes", "configuration": {"endian": "big"}}]
    if kind == "gzip":
        zlib = compression.get("useZlib", False)
        if not isinstance(zlib, bool):
            raise Rejected("useZlib")
        inner.append({"name": "zlib" if zlib else "gzip", "configuration": {"level": _level(compression, "gzip", N5_LEVELS)}})
    elif kind == "zstd":
        inner.append({"name": "zstd", "configuration": {"level": _level(compression, "zstd", N5_LEVELS), "checksum": False}})
    elif kind == "blosc":
        inner.append(_blosc(compression, size, 0))
    elif kind != "raw":
        raise Rejected(f"compression: {kind!r}")
    return _document(shape, dtype, chunks, "/", 0, [{"name": "n5_default", "configuration": {"codecs": inner}}])


def zarr2_type(dtype) -> str:
    order, kind, size = (dtype[0], dtype[1], dtype[2:]) if isinstance(dtype, str) and len(dtype) >= 3 else ("", "", "")
    name = "bool" if kind == "b" and size == "1" else f"{KINDS.get(kind)}{8 * int(size)}" if size in ("1", "2", "4", "8") and kind in "iuf" else None
    if order not in ("<", ">", "|") or name not in SIZES or (order == "|" and SIZES[name] > 1):
        raise Rejected(f"dtype: {dtype!r}")
    return name


def zarr2_fill(value, dtype: str):
    if value is None:
        return False if dtype == "bool" else 0
    if dtype == "bool":
        if not isinstance(value, bool):
            raise Rejected("fill_value")
        return value
    if "int" in dtype:
        bits = 8 * SIZES[dtype]
        signed = dtype[0] == "i"
        return integer(value, -(1 << bits - 1) if signed else 0, (1 << bits - signed) - 1, "fill_value")
    if value in ("NaN", "Infinity", "-Infinity"):
        return value
    if isinstance(value, bool) or not isinstance(value, (int, float)) or abs(value) > LARGEST.get(dtype, 1.7976931348623157e308):
        raise Rejected("fill_value")
    if isinstance(value, float) and value == 0 and str(value)[0] == "-":
        return NEGATIVE_ZERO[dtype]
    return value if isinstance(value, int) else float(value)


def zarr2_array(doc: dict) -> dict:
    """The version 3 document of a Zarr v2 array."""
    integer(doc.get("zarr_format"), 2, 2, "zarr_format")
    shape = integers(doc.get("shape"), 0, 2**53 - 1, "shape")
    chunks = integers(doc.get("chunks"), 1, 2**53 - 1, "chunks")
    if len(shape) > 32 or len(chunks) != len(shape):
        raise Rejected("shape and chunks")
    dtype = zarr2_type(doc.get("dtype"))
    size = SIZES[dtype]
    if doc.get("order") not in ("C", "F") or doc.get("filters") not in (None, []) or doc.get("dimension_separator") not in (None, ".", "/"):
        raise Rejected("order, filters or dimension_separator")
    codecs = [_reversal(len(shape))] if doc["order"] == "F" and len(shape) > 1 else []
    codecs.append({"name": "bytes"} if size == 1 else {"name": "bytes", "configuration": {"endian": "big" if doc["dtype"][0] == ">" else "little"}})
    compressor = doc.get("compressor")
    if compressor is not None:
        kind = compressor.get("id") if isinstance(compressor, dict) else None
        if kind == "blosc":
            codecs.append(_blosc(compressor, size, -1))
        elif isinstance(kind, str) and kind in ZARR_LEVELS:
            more = {}
            if kind == "zstd":
                more = {"checksum": compressor.get("checksum", False)}
                if not isinstance(more["checksum"], bool):
                    raise Rejected("checksum")
            codecs.append({"name": kind, "configuration": {"level": _level(compressor, kind, ZARR_LEVELS)} | more})
        else:
            raise Rejected(f"compressor: {kind!r}")
    return _document(shape, dtype, chunks, doc.get("dimension_separator") or ".", zarr2_fill(doc.get("fill_value"), dtype), codecs)


_NODE = "node string, shape array<long>, chunks array<long>, separator string, document string, reject string"


def _node(profile: str, name: str, data: bytes) -> tuple:
    try:
        doc = parse(data)
        if not isinstance(doc, dict):
            raise Rejected("document: no object")
        if profile == "n5" and "dimensions" in doc:
            out = n5_array(doc)
        elif name == ".zarray":
            out = zarr2_array(doc)
        else:
            if name == ".zgroup":
                integer(doc.get("zarr_format"), 2, 2, "zarr_format")
            return "group", None, None, None, json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}}), None
        return "array", out["shape"], out["chunk_grid"]["configuration"]["chunk_shape"], out["chunk_key_encoding"]["configuration"]["separator"], json.dumps(out), None
    except Rejected as e:
        return "rejected", None, None, None, None, str(e)


def choose_profile(objects: DataFrame) -> DataFrame:
    """(profile) of a store by the keys at its root; null if it is of none."""
    has = lambda *names: F.max(F.when(F.col("key").isin(*names), 1))
    got = objects.agg(has(".zarray", ".zgroup").alias("z"), has("attributes.json").alias("n"), has("manifest.safe").alias("s"))
    return got.select(F.when(F.col("z") == 1, "zarr2").when(F.col("n") == 1, "n5").when(F.col("s") == 1, "safe").alias("profile"))


def nodes(documents: DataFrame, profile: str) -> DataFrame:
    """(path, node, shape, chunks, separator, document, reject) of a store's nodes, implied groups too.

    In N5 whatever lies inside a dataset is no node.
    """
    names = ["attributes.json"] if profile == "n5" else [".zarray", ".zgroup"]
    name = F.element_at(F.split("key", "/"), -1)
    path = F.regexp_replace("key", "/?[^/]*$", "")
    known = documents.select(path.alias("path"), name.alias("name"), "data").where(F.col("name").isin(*names))

    @F.pandas_udf(_NODE)
    def read(names: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_node(profile, n, d) for n, d in zip(names, data)], columns=["node", "shape", "chunks", "separator", "document", "reject"])

    got = known.withColumn("n", read("name", "data")).select("path", "n.*")
    if profile == "n5":
        # an attribute "dimensions" makes a dataset even if the rest is rejected
        inside = got.where("node <> 'group'").select("path")
        below = got.select("path", F.explode(F.array_union(F.when(F.col("path") != "", F.array(F.lit(""))).otherwise(F.expr("cast(array() as array<string>)")), ancestors(F.col("path")))).alias("up"))
        nested = below.join(inside.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
        got = got.join(nested, "path", "left_anti")
    group = json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}})
    implied = implied_groups(got.select("path")).select("path", F.lit("group").alias("node"), F.lit(group).alias("document"))
    return got.unionByName(implied, allowMissingColumns=True)


def references(objects: DataFrame, arrays: DataFrame) -> DataFrame:
    """(key, path, index, size): the objects that are chunks of ``arrays`` (path, shape, chunks, separator).

    An object belongs to its nearest ancestor that is an array, if the rest of its key is the canonical form of
    an index inside the grid.  Empty objects are no chunks.
    """
    listed = objects.where(~ignored(F.col("key")) & (F.col("size") > 0)).select("key", "size")
    near = nearest_ancestor(listed, arrays.select("path")).select("key", F.coalesce("node", F.lit("")).alias("path"))
    joined = listed.join(near, "key").join(arrays.select("path", "shape", "chunks", "separator"), "path")
    rest = F.substring(F.col("key"), F.when(F.col("path") == "", 1).otherwise(F.length("path") + 2), F.length("key"))
    parts = F.split(rest, F.when(F.col("separator") == "/", "/").otherwise("[.]"))
    index = F.transform(parts, lambda p: F.when(p.rlike("^(0|[1-9][0-9]{0,15})$"), p.try_cast("bigint")))
    scalar = (F.size("shape") == 0) & (rest == "0")
    grid = F.zip_with("shape", "chunks", lambda s, c: F.ceil(s / c))
    inside = (F.size("_index") == F.size("shape")) & F.coalesce(F.forall(F.zip_with("_index", grid, lambda i, n: F.coalesce(i < n, F.lit(False))), lambda x: x), F.lit(False))
    found = joined.withColumn("_index", index).where(scalar | inside)
    return found.select("key", "path", F.when(scalar, F.expr("cast(array() as array<bigint>)")).otherwise(F.col("_index")).alias("index"), "size")


def virtualize(objects: DataFrame, documents: DataFrame, profile: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, chunks, others): documents by key, references to chunk objects, and the objects that are neither."""
    tree = nodes(documents, profile)
    out = tree.select(F.when(F.col("path") == "", "zarr.json").otherwise(F.concat("path", F.lit("/zarr.json"))).alias("key"), "document", "reject")
    chunks = references(objects, tree.where("node = 'array'"))
    used = chunks.select("key").unionByName(documents.select("key"))
    return out, chunks, objects.join(used, "key", "left_anti")
