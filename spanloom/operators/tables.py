"""Source tables and page indexes: interning, use counts and as-of look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def by_use(refs: DataFrame, url: str = "url", pos: str = "pos") -> DataFrame:
    """(url, n, idx): distinct urls by descending use, then by first use, so that the most used gets index 0."""
    used = refs.groupBy(url).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return blocks.numbered(used, [F.desc("n"), "first"], "idx").select(url, "n", "idx")


def by_first_use(refs: DataFrame, value: str = "source", order: tuple[str, ...] = ("key", "part")) -> DataFrame:
    """(value, idx): distinct values numbered in the order in which they are met first."""
    first = refs.groupBy(value).agg(F.min(F.struct(*order)).alias("first"))
    return blocks.numbered(first, ["first"], "idx").select(value, "idx")


def build_pages(entries: DataFrame, per_page: int) -> DataFrame:
    """(page, first_key, last_key, n): pages of ``per_page`` keys in byte order."""
    placed = blocks.numbered(entries.select("key"), ["key"], "_n").select("key", F.floor(F.col("_n") / per_page).cast("bigint").alias("page"))
    return placed.groupBy("page").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))


def page_of(keys: DataFrame, pages: DataFrame, parts: int | None = None) -> DataFrame:
    """(key, page): the last page whose first key is not after the key; null before the first page.

    An as-of join for page tables of any size: union, sort by ranges of keys, carry the last page on.  The last page
    of each range of keys is carried into the next by its place, so no window spans all rows.
    """
    both = keys.select("key", F.lit(1).alias("o"), F.lit(None).cast("bigint").alias("page")).unionByName(
        pages.select(F.col("first_key").alias("key"), F.lit(0).alias("o"), "page")
    )
    dealt = blocks.ranged(both, ["key", "o"], parts)
    last = dealt.groupBy("_part").agg(F.max_by("page", F.when(F.col("page").isNotNull(), F.col("_at"))).alias("end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = last.select("_part", F.last("end", True).over(before).alias("carry"))
    run = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("page", F.last("page", True).over(run)).join(F.broadcast(carried), "_part").where("o = 1").select("key", F.coalesce("page", "carry").alias("page"))


def pages_with_prefix(pages: DataFrame, prefix: str) -> DataFrame:
    """The pages that may hold a key that starts with ``prefix``."""
    end = prefix[:-1] + chr(ord(prefix[-1]) + 1) if prefix else None
    held = F.col("last_key") >= prefix
    return pages.where(held & (F.col("first_key") < end) if end else held)


def page_faults(pages: DataFrame) -> DataFrame:
    """(page, fault) for pages (page, first_key, offset, length) that are empty, overlap, leave gaps or are out of order.

    A page meets the one of the number before it, so pages are numbered without holes.
    """
    last = pages.select((F.col("page") + 1).alias("page"), F.col("first_key").alias("_key"), (F.col("offset") + F.col("length")).alias("_end"))
    fault = F.when(F.col("length") <= 0, "empty").when(F.col("_key") >= F.col("first_key"), "order").when(F.col("_end") != F.col("offset"), "contiguity")
    return pages.join(last, "page", "left").select("page", fault.alias("fault")).where("fault is not null")


def virtual_offsets(objects: DataFrame) -> DataFrame:
    """``objects`` (key, size) laid end to end in order of their keys, with ``begin``.

    Sums of ranges of keys are added up first, so that no single task sees all objects.
    """
    dealt = blocks.ranged(objects, ["key"])
    run = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    base = F.broadcast(blocks.before_parts(dealt, F.sum("size")))  # a row for each partition
    placed = dealt.withColumn("_run", F.coalesce(F.sum("size").over(run), F.lit(0))).join(base, "_part")
    return placed.withColumn("begin", (F.col("_before") + F.col("_run")).cast("bigint")).drop("_part", "_at", "_run", "_before")


def object_at(offsets: DataFrame, placed: DataFrame) -> DataFrame:
    """(offset, key, within): the object that holds each virtual offset; offsets outside of all objects are left out.

    An as-of join: objects do not overlap, so an offset's object is the last one that begins at or before it.
    """
    none = F.lit(None)
    began = placed.where("size > 0").select(F.col("begin").alias("at"), F.lit(0).alias("o"), F.struct("key", "begin", "size").alias("object"))
    both = began.unionByName(offsets.select(F.col("offset").alias("at"), F.lit(1).alias("o"), none.cast(began.schema["object"].dataType).alias("object")))
    dealt = blocks.ranged(both, ["at", "o"])
    last = dealt.groupBy("_part").agg(F.max_by("object", F.when(F.col("object").isNotNull(), F.col("_at"))).alias("end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = last.select("_part", F.last("end", True).over(before).alias("carry"))
    run = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumn("object", F.last("object", True).over(run)).join(F.broadcast(carried), "_part").where("o = 1")
    met = met.select(F.col("at").alias("offset"), F.coalesce("object", "carry").alias("object"))
    return met.where("offset < object.begin + object.size").select("offset", "object.key", (F.col("offset") - F.col("object.begin")).alias("within"))
