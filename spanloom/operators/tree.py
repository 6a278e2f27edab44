"""Trees of elements: paths, subtrees, canonical order, runs of equal siblings.

elements (id, parent, name, kind, start, len); the root has a null parent.  Depth is bounded by ``depth``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paths(elements: DataFrame, depth: int) -> DataFrame:
    """(id, path): names from the root joined by ``/``; one join a level."""
    level = elements.where("parent is null").select("id", F.col("name").alias("path"))
    out = level
    for _ in range(depth - 1):
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("_up"))
        level = elements.join(up, "parent").select("id", F.concat_ws("/", "_up", "name").alias("path"))
        out = out.unionByName(level)
    return out


def subtree_sums(elements: DataFrame, depth: int, value: str = "one") -> DataFrame:
    """(id, total): the sum of ``value`` over each element and all below it.

    Sums go up level by level, each a join and an aggregate with map-side combining.
    """
    out = elements.select("id", "parent", F.col(value).cast("bigint").alias("total"))
    level = out
    for _ in range(depth - 1):
        level = level.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum("total").alias("total"))
        level = level.join(elements.select("id", "parent"), "id").select("id", "parent", "total")
        out = out.unionByName(level)
    return out.groupBy("id").agg(F.sum("total").cast("bigint").alias("total"))


def first_bytes(elements: DataFrame, depth: int) -> DataFrame:
    """(id, first): an element's own start if it has a length, else the least first byte below it.

    Elements with a length of their own stop the search; only those without one take over what is below.
    """
    own = elements.select("id", "parent", F.when(F.col("len") > 0, F.col("start")).alias("first"))
    known, level = own, own
    for _ in range(depth - 1):
        below = level.where("first is not null and parent is not null").groupBy(F.col("parent").alias("id")).agg(F.min("first").alias("_below"))
        level = own.where("first is null").join(below, "id").select("id", "parent", F.col("_below").alias("first"))
        known = known.unionByName(level)
    return known.groupBy("id").agg(F.min("first").alias("first"))


def sibling_names(elements: DataFrame) -> DataFrame:
    """``elements`` with ``k``, how many earlier siblings have the same name, and ``shown``, ``name~k`` if any."""
    order = Window.partitionBy("parent", "name").orderBy("start", "id")
    k = (F.row_number().over(order) - 1).cast("bigint")
    return elements.withColumn("k", k).withColumn("shown", F.when(F.col("k") > 0, F.concat("name", F.lit("~"), F.col("k").cast("string"))).otherwise(F.col("name")))


def canonical_order(elements: DataFrame, depth: int) -> DataFrame:
    """(id, sort): elements depth first; siblings by their name group's first byte, name, own first byte and id.

    The sort key is the array of these along the path: arrays compare element by element and a prefix comes
    first, so one sort by it is the whole order.
    """
    first = elements.join(first_bytes(elements, depth), "id")
    group = F.min("first").over(Window.partitionBy("parent", "name"))
    step = F.struct(F.coalesce("_group", F.lit(-1)).alias("g"), F.col("name"), F.coalesce("first", F.lit(-1)).alias("f"), F.col("id").alias("i"))
    keyed = first.withColumn("_group", group).select("id", "parent", step.alias("step"))
    level = keyed.where("parent is null").select("id", F.array("step").alias("sort"))
    out = level
    for _ in range(depth - 1):
        up = level.select(F.col("id").alias("parent"), F.col("sort").alias("_up"))
        level = keyed.join(up, "parent").select("id", F.concat("_up", F.array("step")).alias("sort"))
        out = out.unionByName(level)
    return out


def fold_runs(elements: DataFrame, by: tuple[str, ...] = ("parent", "shape")) -> DataFrame:
    """(by, root, count, stride): consecutive siblings of a shape at a constant stride, folded into runs."""
    order = Window.partitionBy(*by).orderBy("start", "id")
    step = elements.withColumn("_d", F.col("start") - F.lag("start").over(order)).withColumn("_next", F.lead("start").over(order) - F.col("start"))
    # a run goes on while the stride stays; its first element belongs to the stride that follows it
    new = F.when(F.col("_d").isNull() | (F.col("_d") != F.lag("_d").over(order)) & F.lag("_d").over(order).isNotNull(), 1).otherwise(0)
    runs = step.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stride = F.max(F.when(F.col("_new") == 0, F.col("_d")))
    return runs.groupBy(*by, "_run").agg(F.min("id").alias("root"), F.count("*").alias("count"), F.coalesce(stride, F.lit(0)).alias("stride"), F.min("start").alias("start")).drop("_run")


def expand_runs(runs: DataFrame) -> DataFrame:
    """(root, k, start): every member of runs (root, start, count, stride)."""
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)).alias("k")
    return runs.where("count > 0").select("root", "start", "stride", k).select("root", "k", (F.col("start") + F.col("k") * F.col("stride")).alias("start"))


def follow(aliases: DataFrame, depth: int = 64) -> DataFrame:
    """(alias, target): alias chains followed to their ends; chains longer than ``depth`` and cycles give null.

    Pointers double each round, so ``depth`` steps take its logarithm of joins.
    """
    ends = aliases.select("alias", "target")
    steps = 1
    while steps < depth:
        up = ends.select(F.col("alias").alias("target"), F.col("target").alias("_up"))
        ends = ends.join(up, "target", "left").select("alias", F.coalesce("_up", "target").alias("target"))
        steps *= 2
    open_ = aliases.select(F.col("alias").alias("target"), F.lit(True).alias("_open"))
    return ends.join(open_, "target", "left").select("alias", F.when(F.col("_open").isNull(), F.col("target")).alias("target"))


def name_faults(elements: DataFrame) -> DataFrame:
    """(id, fault): names that are empty, equal a sibling's, or go on below a sibling's name and a slash."""
    same = F.count("*").over(Window.partitionBy("parent", "name"))
    bad = elements.withColumn("_n", same)
    own = bad.select("id", F.when(F.col("name") == "", "empty").when(F.col("_n") > 1, "equal").alias("fault")).where("fault is not null")
    parts = F.split("name", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below = elements.where(F.col("name").contains("/")).select("id", "parent", F.explode(prefixes).alias("name"))
    inside = below.join(elements.select("parent", "name").distinct(), ["parent", "name"], "left_semi").select("id", F.lit("inside").alias("fault"))
    return own.unionByName(inside.distinct())
