"""Equivalence of two stores, and seeded mutants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, status): ``only left``, ``only right``, ``differs`` or ``equal`` for each key of either; nulls are equal."""
    a = left.select(key, F.struct(*values).alias("_a"))
    b = right.select(key, F.struct(*values).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "only left").when(F.col("_a").isNull(), "only right")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("differs")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def summary(compared: DataFrame) -> DataFrame:
    return compared.groupBy("status").agg(F.count("*").alias("n"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def mutate(objects: DataFrame, seed: int) -> DataFrame:
    """``objects`` (key, data) with one seeded mutation each: a cut end (20 %), a byte near an edge (60 %) or anywhere."""
    h = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1000))
    n = F.octet_length("data")
    near = F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.least(n, F.lit(32)).cast("bigint"))
    spot = F.when(h < 800, F.when(h % 2 == 0, near).otherwise(n - 1 - near)).otherwise(F.pmod(F.xxhash64("key", F.lit(seed + 2)), n.cast("bigint"))).cast("int")
    byte = F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64("key", F.lit(seed + 3)), F.lit(256))), 2, "0"))
    cut = F.substring("data", F.lit(1), F.pmod(F.xxhash64("key", F.lit(seed + 4)), n.cast("bigint")).cast("int"))
    changed = F.concat(F.substring("data", F.lit(1), spot), byte, F.substring(F.col("data"), spot + 2, n))
    return objects.withColumn("data", F.when(n == 0, F.col("data")).when(h < 200, cut).otherwise(changed))
