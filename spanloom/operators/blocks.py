"""Running values over long orders without a task that sees all rows of a group, and steps that are kept."""

from __future__ import annotations

import tempfile
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Offsets of one block: a window sees the rows of one block of one group, and then one row for each block.
WIDTH = 1 << 30


#: Rows of a group that one task may order, and buckets in which groups are counted together.
ROWS, BUCKETS = 1 << 20, 1 << 16


def large(df: DataFrame, by: list[str]) -> list[int]:
    """Buckets of groups (``by``) of more than ROWS rows; each group that large is in one of them.

    A bucket is a row in the driver at most, and few are that full.
    """
    bucket = F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).cast("int")
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    return [r["_bucket"] for r in sizes.where(F.col("_n") > ROWS).select("_bucket").collect()]


def block_of(at: Column, width: int = WIDTH) -> Column:
    return F.floor(at / width).cast("bigint")


def running(df: DataFrame, by: list[str], at: str, order: list[str], value: Column, how: str, name: str, inclusive: bool = False, width: int = WIDTH, big: list[int] | None = None) -> DataFrame:
    """``df`` with ``name``: ``how`` (max, sum, last) of ``value`` over the rows before each one, or up to it.

    Rows of a group (``by``) are in order of ``at``, then ``order``.  ``big`` are the ``large`` buckets of the groups:
    where there are none, a window over each group does, and steps on the same groups share one shuffle.  Else, or if
    ``big`` is not told, rows are dealt by blocks of ``at``; what the blocks before hold comes by a join on the same
    keys, which needs no shuffle of its own.  ``last`` skips nulls.  Rows with a null in ``by`` or ``at`` are left out.
    """
    place = [at, *order]
    if big == []:
        rows = df.where(reduce(and_, (F.col(c).isNotNull() for c in [*by, at])))
        own = Window.partitionBy(*by).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return rows.select(*df.columns, {"max": F.max, "sum": F.sum, "last": lambda v: F.last(v, True)}[how](value).over(own).alias(name))
    dealt = df.withColumn("_block", block_of(F.col(at), width)).withColumn("_value", value)
    own = Window.partitionBy(*by, "_block").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    blocks = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    if how == "max":
        inner, total, outer = F.max("_value").over(own), F.max("_value"), F.max("_all").over(blocks)
        both = F.greatest("_inner", "_outer")
    elif how == "sum":
        inner, total, outer = F.sum("_value").over(own), F.sum("_value"), F.sum("_all").over(blocks)
        both = F.when(F.col("_inner").isNotNull() | F.col("_outer").isNotNull(), F.coalesce("_inner", F.lit(0)) + F.coalesce("_outer", F.lit(0)))
    else:
        inner, total, outer = F.last("_value", True).over(own), F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*place))), F.last("_all", True).over(blocks)
        both = F.coalesce("_inner", "_outer")
    before = dealt.groupBy(*by, "_block").agg(total.alias("_all")).withColumn("_outer", outer).drop("_all")
    out = dealt.withColumn("_inner", inner).join(before, [*by, "_block"])
    return out.withColumn(name, both).select(*df.columns, name)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once, in the folder that ``spark.checkpoint.dir`` names; its partitions stay as they are.

    Only a local master, as in tests, gets a folder of its own when the setting is missing.
    """
    spark: SparkSession = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return df.checkpoint(eager=True)


def ranged(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """``df`` sorted by ``order`` over all partitions, with ``_part`` and ``_at``, the row's number in its partition.

    It is kept, as ranges are sampled anew each time they are worked out.  The number of partitions is fixed, so none
    are put together.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return kept(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", number.bitwiseAND(F.lit((1 << 33) - 1))))


def before_parts(dealt: DataFrame, total: Column) -> DataFrame:
    """(_part, _before): the sum of ``total`` over all partitions before; one row for each partition."""
    sums = dealt.groupBy("_part").agg(total.alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))


def numbered(df: DataFrame, order: list, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``, its rows' numbers from 0 in ``order``."""
    dealt = ranged(df, order, parts)
    before = F.broadcast(before_parts(dealt, F.count("*")))  # a row for each partition
    return dealt.join(before, "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint")).drop("_part", "_at", "_before")
