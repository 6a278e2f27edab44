"""TIFF and BigTIFF: directories as rows, tiles and strips as references."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: sizes and struct codes of field types, and the tags that are read
FIELD = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, STRIPS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 270, 273, 277, 278, 279
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SUBIFDS, JPEG_TABLES, FORMAT = 322, 323, 324, 325, 330, 347, 339
JPEG = 7
MOST_IFDS = 1 << 20


class Malformed(ValueError):
    pass


def directories(data: bytes) -> list[dict]:
    """A dict of tags for each directory: number, parent (of SubIFDs) and ``tags`` to lists of values."""
    if data[:2] not in (b"II", b"MM") or len(data) < 8:
        raise Malformed("header")
    end = "<" if data[:2] == b"II" else ">"

    def get(code: str, at: int):
        size = struct.calcsize(end + code)
        if at < 0 or at + size > len(data):
            raise Malformed("beyond the file")
        return struct.unpack_from(end + code, data, at)

    (magic,) = get("H", 2)
    if magic == 43:
        if get("HH", 4) != (8, 0):
            raise Malformed("header")
        count, entry, offset, first = "Q", 20, "Q", get("Q", 8)[0]
    elif magic == 42:
        count, entry, offset, first = "H", 12, "I", get("I", 4)[0]
    else:
        raise Malformed("header")
    out: list[dict] = []
    seen: set[int] = set()
    todo = [(first, None)]
    while todo:
        at, parent = todo.pop(0)
        while at:
            if at in seen or len(out) >= MOST_IFDS:
                raise Malformed("directories repeat")
            seen.add(at)
            (n,) = get(count, at)
            start = at + struct.calcsize(end + count)
            tags = {}
            for k in range(n):
                p = start + k * entry
                tag, kind = get("HH", p)
                (many,) = get(offset, p + 4)
                if kind not in FIELD:
                    continue
                size, code = FIELD[kind]
                inline = p + 4 + struct.calcsize(end + offset)
                total = size * many
                where = inline if total <= struct.calcsize(end + offset) else get(offset, inline)[0]
                if where + total > len(data):
                    raise Malformed("a value lies beyond the file")
                raw = data[where : where + total]
                tags[tag] = raw if kind in (2, 7) else list(struct.unpack(end + code * many, raw))
            number = len(out)
            out.append({"number": number, "parent": parent, "tags": tags})
            if parent is None:
                todo += [(sub, number) for sub in tags.get(SUBIFDS, ())]
            (at,) = get(offset, start + n * entry) if parent is None else (0,)
    return out


def _one(tags: dict, tag: int, default: int | None = None) -> int:
    if tag not in tags and default is None:
        raise Malformed(f"tag {tag} is missing")
    return tags[tag][0] if tag in tags else default


_TILES = T.ArrayType(
    T.StructType(
        [
            T.StructField("ifd", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("chunk_width", T.LongType()),
            T.StructField("chunk_height", T.LongType()), T.StructField("samples", T.LongType()), T.StructField("bits", T.LongType()), T.StructField("compression", T.LongType()), T.StructField("row", T.LongType()),
            T.StructField("col", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("tables", T.BinaryType()),
        ]
    )
)


def tiles_of(data: bytes) -> list[tuple]:
    out = []
    for d in directories(data):
        tags = d["tags"]
        width, height = _one(tags, WIDTH), _one(tags, HEIGHT)
        tiled = TILES in tags
        cw = _one(tags, TILE_WIDTH) if tiled else width
        ch = _one(tags, TILE_HEIGHT) if tiled else min(_one(tags, ROWS, height), height)
        if min(width, height, cw, ch) < 1:
            raise Malformed("a size of 0")
        offsets, lengths = tags.get(TILES if tiled else STRIPS, []), tags.get(TILE_BYTES if tiled else STRIP_BYTES, [])
        across, down = -(-width // cw), -(-height // ch)
        if len(offsets) != len(lengths) or len(offsets) != across * down:
            raise Malformed("chunks do not fill the image")
        tables = bytes(tags[JPEG_TABLES]) if JPEG_TABLES in tags and _one(tags, COMPRESSION, 1) == JPEG else None
        fixed = (d["number"], d["parent"], width, height, cw, ch, _one(tags, SAMPLES, 1), _one(tags, BITS, 1), _one(tags, COMPRESSION, 1))
        for k, (offset, length) in enumerate(zip(offsets, lengths)):
            if length:  # an empty chunk is absent
                out.append((*fixed, k // across, k % across, offset, length, tables))
    return out


def tiles(files: DataFrame) -> DataFrame:
    """(url, reject, ifd, ..., row, col, offset, length, tables): chunks of all directories of files (url, data)."""

    @F.pandas_udf(T.StructType([T.StructField("reject", T.StringType()), T.StructField("tiles", _TILES)]))
    def read(data: pd.Series) -> pd.DataFrame:
        out = []
        for raw in data:
            try:
                out.append((None, [dict(zip(_TILES.elementType.names, t)) for t in tiles_of(bytes(raw))]))
            except Malformed as e:
                out.append((str(e), []))
        return pd.DataFrame(out, columns=["reject", "tiles"])

    got = files.select("url", read("data").alias("r"))
    return got.select("url", F.col("r.reject").alias("reject"), F.explode_outer("r.tiles").alias("t")).select("url", "reject", "t.*")


def recipes(chunks: DataFrame) -> DataFrame:
    """(url, ifd, row, col, part, offset, length, data): the ranges that make each chunk decodable by itself.

    A JPEG chunk with shared tables is its first two bytes, the tables without their first and last two, and the rest.
    """
    part = lambda n, offset, length, data: F.struct(F.lit(n).alias("part"), offset.cast("bigint").alias("offset"), length.cast("bigint").alias("length"), data.cast("binary").alias("data"))
    none = F.lit(None)
    body = F.substring(F.col("tables"), F.lit(3), F.octet_length("tables") - 4)
    whole = F.array(part(0, F.col("offset"), F.col("length"), none))
    split = F.array(part(0, F.col("offset"), F.lit(2), none), part(1, none, none, body), part(2, F.col("offset") + 2, F.col("length") - 2, none))
    each = chunks.where("reject is null").select("url", "ifd", "row", "col", F.explode(F.when(F.col("tables").isNull(), whole).otherwise(split)).alias("p"))
    return each.select("url", "ifd", "row", "col", "p.*")


def pyramid(levels: list[tuple[int, int]]) -> list[int]:
    """Numbers of the sizes that are levels: each strictly smaller in both than the last that was taken."""
    taken: list[int] = []
    for k, (w, h) in enumerate(levels):
        if not taken or (w < levels[taken[-1]][0] and h < levels[taken[-1]][1]):
            taken.append(k)
    return taken
