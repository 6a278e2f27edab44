"""Sweeps over extents: coverage, holes, aliases of overlaps.

Extents of a space are dealt by blocks of their starts, so that a space of one large file is not one task's work.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def holes(leaves: DataFrame, spaces: DataFrame, width: int = blocks.WIDTH, big: list[int] | None = None) -> DataFrame:
    """(space, start, len): what leaves (space, start, len) leave uncovered of spaces (space, size)."""
    ends = leaves.where("len > 0").select("space", "start", (F.col("start") + F.col("len")).alias("stop"))
    ends = ends.unionByName(spaces.select("space", F.col("size").alias("start"), F.col("size").alias("stop")))
    out = blocks.running(ends, ["space"], "start", ["stop"], F.col("stop"), "max", "_reach", width=width, big=blocks.large(ends, ["space"]) if big is None else big)
    out = out.withColumn("_at", F.coalesce("_reach", F.lit(0))).where("start > _at")
    return out.select("space", F.col("_at").alias("start"), (F.col("start") - F.col("_at")).alias("len"))


def partition_faults(leaves: DataFrame, spaces: DataFrame, width: int = blocks.WIDTH) -> DataFrame:
    """(space, faults) of the spaces that leaves do not tile exactly: from 0, each at its predecessor's end, to the size."""
    big = blocks.large(leaves, ["space"])
    placed = blocks.running(leaves.select("space", "start", "len"), ["space"], "start", ["len"], F.col("start") + F.col("len"), "last", "_prev", width=width, big=big)
    wrong = (F.col("start") != F.coalesce("_prev", F.lit(0))).cast("int")
    bad = placed.groupBy("space").agg(F.sum(wrong).alias("bad"), F.max(F.col("start") + F.col("len")).alias("end"))
    joined = spaces.join(bad, "space", "left")
    faults = F.coalesce("bad", F.lit(0)) + (F.coalesce("end", F.lit(0)) != F.col("size")).cast("int")
    return joined.select("space", faults.cast("bigint").alias("faults")).where("faults > 0")


def claimed(leaves: DataFrame, width: int = blocks.WIDTH, big: list[int] | None = None) -> DataFrame:
    """``leaves`` (space, id, start, len) with ``target``: null if the leaf claims its bytes, else who claims its first.

    Leaves claim by start, then id.  One that begins before the end of the last claim is an alias of that claimant
    and does not move the end, unlike in a running maximum.  A leaf without bytes claims none and is no alias.  Leaves
    that touch no other are apart; only those that overlap in a chain are put together and walked in order, chain by
    chain.  ``big`` are the ``blocks.large`` buckets of leaves, which are counted if they are not told.
    """
    big = blocks.large(leaves, ["space"]) if big is None else big
    rows = leaves.select("space", "id", "start", "len")
    some = rows.where("len > 0")
    reached = blocks.running(some, ["space"], "start", ["id"], F.col("start") + F.col("len"), "max", "_reach", width=width, big=big)
    new = F.col("_reach").isNull() | (F.col("start") >= F.col("_reach"))
    chains = blocks.running(reached.withColumn("_new", new), ["space"], "start", ["id"], F.when(F.col("_new"), F.col("id")), "last", "_chain", True, width, big)

    def walk(batches):
        for b in batches:
            out = []
            for space, chain in zip(b["space"], b["chain"]):
                end, owner = -1, None
                for x in chain:
                    start, id_, length = x["start"], x["id"], x["len"]
                    out.append((space, id_, start, length, owner if start < end else None))
                    if start >= end:
                        end, owner = start + length, id_
            done = pd.DataFrame(out, columns=["space", "id", "start", "len", "target"])
            yield done.assign(target=pd.array(done["target"], "Int64"))

    none = F.lit(None).cast("long").alias("target")
    members = F.array_sort(F.collect_list(F.struct("start", "id", "len")))
    if big == []:  # the next leaf of the space tells whether a chain goes on
        after = F.lead("_new", 1, True).over(Window.partitionBy("space").orderBy("start", "id"))
        chains = chains.withColumn("_alone", F.col("_new") & after)
        one = chains.where("_alone").select("space", "id", "start", "len", none)
        chained = chains.where("not _alone").groupBy("space", "_chain").agg(members.alias("chain")).drop("_chain")
    else:
        every = chains.groupBy("space", "_chain").agg(members.alias("chain")).drop("_chain")
        one = every.where("size(chain) = 1").select("space", F.col("chain")[0].alias("x")).select("space", "x.id", "x.start", "x.len", none)
        chained = every.where("size(chain) > 1")
    walked = chained.mapInPandas(walk, "space long, id long, start long, len long, target long")
    return one.unionByName(walked).unionByName(rows.where("len <= 0").select("*", none))


def finish(leaves: DataFrame, spaces: DataFrame, width: int = blocks.WIDTH) -> DataFrame:
    """(space, id, kind, start, len, target): overlaps become aliases of the first claimant, holes become gaps."""
    leaves = blocks.kept(leaves.select("space", "id", "start", "len"))
    big = blocks.large(leaves.select("space").unionByName(spaces.select("space")), ["space"])
    done = blocks.kept(claimed(leaves, width, big))
    found = done.select("space", "id", F.when(F.col("target").isNull(), "leaf").otherwise("alias").alias("kind"), "start", "len", "target")
    none = F.lit(None).cast("long")
    gaps = holes(done.where("target is null").select("space", "start", "len"), spaces, width, big)
    return found.unionByName(gaps.select("space", none.alias("id"), F.lit("gap").alias("kind"), "start", "len", none.alias("target")))
