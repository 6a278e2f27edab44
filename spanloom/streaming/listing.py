"""Listings as streams: objects are taken once, late ones are dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefixes import ancestors, ignored


def new_objects(listing: DataFrame, late: str = "1 hour") -> DataFrame:
    """(key, size, seen) of a stream of listings, each key once within the watermark, without ignored keys."""
    kept = listing.where(~ignored(F.col("key")))
    return kept.withWatermark("seen", late).dropDuplicatesWithinWatermark(["key"])


def directory_sizes(objects: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, dir, objects, bytes): what arrived below each directory in tumbling windows."""
    below = objects.withWatermark("seen", late).select("seen", "size", F.explode(ancestors(F.col("key"))).alias("dir"))
    return below.groupBy(F.window("seen", window), "dir").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))
