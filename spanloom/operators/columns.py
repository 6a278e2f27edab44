"""Encodings of integer columns (grp, j, v): constant, arithmetic, delta; 64-bit wrapping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wrapped(value):
    """A decimal as the signed 64-bit integer that it is modulo 2**64."""
    m = F.expr("cast(18446744073709551616 as decimal(20,0))")
    low = F.pmod(value.cast("decimal(38,0)"), m)
    return F.when(low >= F.expr("cast(9223372036854775808 as decimal(20,0))"), low - m).otherwise(low).cast("bigint")


def delta_encode(values: DataFrame) -> DataFrame:
    """(grp, j, d): the first value, then differences to the value before, wrapping."""
    order = Window.partitionBy("grp").orderBy("j")
    before = F.coalesce(F.lag("v").over(order), F.lit(0)).cast("decimal(38,0)")
    return values.select("grp", "j", wrapped(F.col("v").cast("decimal(38,0)") - before).alias("d"))


def delta_decode(deltas: DataFrame) -> DataFrame:
    """(grp, j, v): the inverse of ``delta_encode``."""
    run = Window.partitionBy("grp").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("grp", "j", wrapped(F.sum(F.col("d").cast("decimal(38,0)")).over(run)).alias("v"))


def encodings(values: DataFrame) -> DataFrame:
    """(grp, encoding, v0, step): the cheapest encoding of each column: constant, arithmetic, else delta."""
    order = Window.partitionBy("grp").orderBy("j")
    d = values.withColumn("_d", F.col("v") - F.lag("v").over(order))
    got = d.groupBy("grp").agg(F.min_by("v", "j").alias("v0"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("_d").alias("dl"), F.max("_d").alias("dh"), F.count("*").alias("n"))
    encoding = F.when(F.col("lo") == F.col("hi"), "constant").when(F.col("dl") == F.col("dh"), "arithmetic").otherwise("delta")
    return got.select("grp", encoding.alias("encoding"), "v0", F.when(encoding == "arithmetic", F.col("dl")).alias("step"))


def starts_as_gaps(rows: DataFrame) -> DataFrame:
    """``rows`` (grp, j, start, len) with ``gap``, the distance from the end of the last earlier row that has a length."""
    order = Window.partitionBy("grp").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    end = F.last(F.when(F.col("len") > 0, F.col("start") + F.col("len")), True).over(order)
    return rows.withColumn("gap", F.col("start") - F.coalesce(end, F.lit(0)))


def column_runs(values: DataFrame, least: int = 3, widest: int = 4) -> DataFrame:
    """(grp, at, period, repeats): runs of a repeated pattern of 1 to ``widest`` values, found greedily from the left.

    At each place the pattern of most rows is taken, the shorter period on a tie, if it repeats ``least`` times.
    """

    def scan(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("j")
        v, out, i = b["v"].to_numpy(), [], 0
        while i < len(v):
            best = (0, 0, 0)
            for p in range(1, min(widest, (len(v) - i) // 2) + 1):
                same = v[i + p :] == v[i : len(v) - p]
                r = 1 + (len(same) if same.all() else int(np.argmin(same))) // p
                if r >= least and r * p > best[0]:
                    best = (r * p, p, r)
            if best[0]:
                out.append((b["grp"].iloc[0], i, best[1], best[2]))
            i += best[0] or 1
        return pd.DataFrame(out, columns=["grp", "at", "period", "repeats"])

    return values.groupBy("grp").applyInPandas(scan, "grp long, at long, period long, repeats long")
