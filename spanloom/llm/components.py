"""Connected components by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component) for every end of an edge between two ids; component is the least id that can be reached.

    A round points each vertex at its neighbour of least hash, if that is less than its own, follows the
    pointers (four steps), renames the ends of the edges and drops loops and repeats, until no edge is left.
    In the random order of the hashes chains of pointers are short, so the vertices fall by a constant factor
    each round, on long paths too, and stars go at once.  Minima are combined before the shuffle, the rest are
    equality joins that Spark can split, so a hub is no single task's burden; nothing comes to the driver but
    whether edges are left.  Nulls, loops and repeats are ignored; an empty table gives an empty one.
    """
    a, b = F.least(u, v).alias("a"), F.greatest(u, v).alias("b")
    e = stash(edges.where(f"{u} <> {v}").select(a, b).distinct(), "edges")
    names = e.select(F.col("a").alias("id")).union(e.select("b")).distinct().select("id", F.col("id").alias("component"))
    used = [e]
    while not e.isEmpty():
        ends = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
        to = ends.groupBy("b").agg(F.min(rank("a")).alias("m")).where(F.col("m") < rank("b"))
        to = to.select("b", F.col("m.a").alias("p"))
        for _ in range(2):
            up = to.select(F.col("b").alias("p"), F.col("p").alias("q"))
            to = to.join(up, "p", "left").select("b", F.coalesce("q", "p").alias("p"))
        to = stash(to, "pointers")
        e = e.join(to.select(F.col("b").alias("a"), F.col("p").alias("pa")), "a", "left")
        e = e.join(to.select("b", F.col("p").alias("pb")), "b", "left")
        e = e.select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
        e = stash(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        names = names.join(to.select(F.col("b").alias("component"), "p"), "component", "left")
        names = names.select("id", F.coalesce("p", "component").alias("component"))
        used += [to, e]
    names = stash(names, "names")
    unstash(*used)
    # kept apart, so that Spark can split the rows of a large component
    least = stash(names.groupBy("component").agg(F.min("id").alias("least")), "least")
    return names.join(least, "component").select("id", F.col("least").alias("component"))
