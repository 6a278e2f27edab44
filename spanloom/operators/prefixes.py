"""Keys as paths: directories, ancestors, implied groups, unused objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(key: Column) -> Column:
    """All proper ancestors of a path, the shortest first."""
    parts = F.split(key, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.expr("cast(array() as array<string>)"))


def directories(objects: DataFrame) -> DataFrame:
    """(dir): the distinct directories that keys imply."""
    return objects.select(F.explode(ancestors(F.col("key"))).alias("dir")).distinct()


def nearest_ancestor(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node): the longest of ``nodes`` (path) that is an ancestor of each key, null if none is.

    Prefixes are exploded and joined for equality, and the longest is kept by a combining aggregate.
    """
    up = keys.select("key", F.explode(ancestors(F.col("key"))).alias("path"))
    found = up.join(nodes.select("path").distinct(), "path").groupBy("key").agg(F.max_by("path", F.length("path")).alias("node"))
    return keys.select("key").join(found, "key", "left")


def unused(objects: DataFrame, used: DataFrame) -> DataFrame:
    """The objects that no reference uses."""
    return objects.join(used.select("key").distinct(), "key", "left_anti")


def implied_groups(nodes: DataFrame) -> DataFrame:
    """(path): ancestors of nodes (path) that are no nodes themselves."""
    implied = nodes.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return implied.join(nodes.select("path"), "path", "left_anti")


def ignored(key: Column) -> Column:
    """Keys that a listing does not count: empty, folder markers, and those with an empty, ``.`` or ``..`` segment."""
    return (key == "") | key.endswith("/") | F.exists(F.split(key, "/"), lambda s: s.isin("", ".", ".."))
