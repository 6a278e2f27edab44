"""The format of a file by its first bytes, and NIfTI headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def format_of(head: Column) -> Column:
    """The profile of a file whose first 552 bytes are ``head``; null if none takes it."""
    at = lambda start, n: F.hex(F.substring(head, start + 1, n))
    return (
        F.when(at(128, 4) == "4449434D", "dicom")
        .when(at(0, 4).isin("49492A00", "4D4D002A", "49492B00", "4D4D002B"), "tiff")
        .when(at(0, 4) == "DACEBE0A", "nd2")
        .when(at(0, 10) == "5A495352415746494C45", "czi")
        .when(at(0, 8) == "894844460D0A1A0A", "ims")
        .when((at(344, 3).isin("6E2B31", "6E6931")) | (at(4, 3) == "6E2B32"), "nifti")
        .when(at(0, 4) == "504B0304", "safe")
    )


# fixed values: codes of data types
NIFTI_TYPES = {2: "uint8", 4: "int16", 8: "int32", 16: "float32", 32: "complex64", 64: "float64", 256: "int8", 512: "uint16", 768: "uint32", 1024: "int64", 1280: "uint64"}

_HEADER = T.StructType(
    [
        T.StructField("version", T.IntegerType()), T.StructField("endian", T.StringType()), T.StructField("shape", T.ArrayType(T.LongType())), T.StructField("dtype", T.StringType()),
        T.StructField("voxel_offset", T.LongType()), T.StructField("scale", T.ArrayType(T.DoubleType())), T.StructField("slope", T.DoubleType()), T.StructField("intercept", T.DoubleType()), T.StructField("reject", T.StringType()),
    ]
)


def nifti_header(raw: bytes) -> tuple:
    none = (None,) * 8
    for endian in "<>":
        (size,) = struct.unpack_from(endian + "i", raw) if len(raw) >= 4 else (0,)
        if size in (348, 540):
            break
    else:
        return (*none, "header: size")
    if len(raw) < size:
        return (*none, "header: cut off")
    if size == 348:
        dim = struct.unpack_from(endian + "8h", raw, 40)
        (code,) = struct.unpack_from(endian + "h", raw, 70)
        pixdim = struct.unpack_from(endian + "8f", raw, 76)
        offset, slope, intercept = struct.unpack_from(endian + "3f", raw, 108)
        magic, version = raw[344:348], 1
    else:
        dim = struct.unpack_from(endian + "8q", raw, 16)
        (code,) = struct.unpack_from(endian + "h", raw, 12)
        pixdim = struct.unpack_from(endian + "8d", raw, 104)
        (offset,) = struct.unpack_from(endian + "q", raw, 168)
        slope, intercept = struct.unpack_from(endian + "2d", raw, 176)
        magic, version = raw[4:8], 2
    if magic != (b"n+1\0", b"n+2\0")[version - 1]:
        return (*none, "header: magic")
    if not 1 <= dim[0] <= 7 or any(n < 1 for n in dim[1 : dim[0] + 1]):
        return (*none, "header: dim")
    if code not in NIFTI_TYPES:
        return (*none, f"header: datatype {code}")
    shape = list(dim[1 : dim[0] + 1])
    return version, "little" if endian == "<" else "big", shape, NIFTI_TYPES[code], int(offset), [abs(float(x)) for x in pixdim[1 : dim[0] + 1]], float(slope), float(intercept), None


def nifti(files: DataFrame) -> DataFrame:
    """(url, version, endian, shape, dtype, voxel_offset, scale, slope, intercept, reject) of files (url, head)."""

    @F.pandas_udf(_HEADER)
    def read(head: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nifti_header(bytes(h)) for h in head], columns=_HEADER.names)

    return files.withColumn("h", read("head")).select("url", "h.*")


def nifti_planes(headers: DataFrame) -> DataFrame:
    """(url, index, offset, length): the planes of the last axes as ranges of the file; the first two axes are one plane."""
    sizes = {"uint8": 1, "int8": 1, "int16": 2, "uint16": 2, "int32": 4, "uint32": 4, "float32": 4}
    width = F.lit(8)
    for name, n in sizes.items():
        width = F.when(F.col("dtype") == name, n).otherwise(width)
    product = lambda a: F.aggregate(a, F.lit(1).cast("bigint"), lambda x, y: x * y)
    good = headers.where("reject is null")
    plane = product(F.slice("shape", 1, 2)) * width
    count = F.when(F.size("shape") > 2, product(F.slice(F.col("shape"), F.lit(3), F.size("shape")))).otherwise(F.lit(1))
    out = good.select("url", "voxel_offset", plane.cast("bigint").alias("length"), F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("index"))
    return out.select("url", "index", (F.col("voxel_offset") + F.col("index") * F.col("length")).alias("offset"), "length")
