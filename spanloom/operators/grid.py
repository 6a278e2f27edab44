"""Chunk grids: keys, presence, coordinates, shards, cuts and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ravel(index: list[Column], shape: list[Column]) -> Column:
    """The row-major number of a multi-index."""
    out = F.lit(0).cast("bigint")
    for i, n in zip(index, shape):
        out = out * n + i
    return out


def unravel(number: Column, shape: list[Column]) -> list[Column]:
    """The multi-index of a row-major number."""
    out = []
    for n in reversed(shape):
        out.append(F.pmod(number, n).cast("bigint"))
        number = F.floor(number / n).cast("bigint")
    return out[::-1]


def chunk_of(cell: list[Column], chunk: list[Column]) -> list[Column]:
    return [F.floor(c / n).cast("bigint") for c, n in zip(cell, chunk)]


def chunk_key(path: Column, index: list[Column], separator: str = "/") -> Column:
    return F.concat_ws("/", path, F.concat_ws(separator, F.lit("c"), *(i.cast("string") for i in index)))


def canonical_index(name: Column, grid: list[Column], separator: str = r"\.") -> Column:
    """Whether ``name`` is a chunk's index in the grid: decimal without leading zeros, inside on each axis."""
    parts = F.split(name, separator)
    ok = F.size(parts) == len(grid)
    for k, n in enumerate(grid):
        part = F.get(parts, F.lit(k))
        ok = ok & part.rlike("^(0|[1-9][0-9]{0,17})$") & (part.try_cast("bigint") < n)
    return F.coalesce(ok, F.lit(False))


def all_chunks(arrays: DataFrame, axes: list[str]) -> DataFrame:
    """``arrays`` with a row for each place of its grid; column ``c_<axis>`` counts to ceil(shape / chunk)."""
    out = arrays
    for a in axes:
        n = F.ceil(F.col(f"shape_{a}") / F.col(f"chunk_{a}")).cast("bigint")
        out = out.withColumn(f"c_{a}", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))))
    return out


def filled_plane(arrays: DataFrame, chunks: DataFrame, axes: tuple[str, str], value: str, fill) -> DataFrame:
    """(c_<axis> of both, value): every place of the grid of one array (``arrays``, a row) with its chunk's value, or ``fill``.

    Places are never dealt, joined or sorted: only the chunks are, and each place of the first axis begins a row of the
    grid.  A chunk, or that beginning, then stands for the places up to the next chunk of its row.  What is shuffled
    grows with the chunks and the first axis, while the places are written as they come.
    """
    a, b = (f"c_{axis}" for axis in axes)
    spark = arrays.sparkSession
    count = lambda axis: F.ceil(F.col(f"shape_{axis}") / F.col(f"chunk_{axis}")).cast("bigint")
    sized = F.broadcast(arrays.select(count(axes[0]).alias("_rows"), count(axes[1]).alias("_n")))  # one row
    begins = all_chunks(arrays, [axes[0]]).select(a, F.lit(-1).cast("bigint").alias(b), F.lit(None).alias(value))
    held = chunks.where((F.col(a) >= 0) & (F.col(b) >= 0)).select(a, b, value)
    inside = held.unionByName(begins).join(sized).where((F.col(a) < F.col("_rows")) & (F.col(b) < F.col("_n")))
    dealt = inside.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), a)
    following = F.lead(b).over(Window.partitionBy(a).orderBy(b))
    first = F.greatest(F.col(b), F.lit(0).cast("bigint"))
    some = dealt.withColumn("_next", F.coalesce(following, "_n")).where(first < F.col("_next"))
    each = some.select(a, F.col(b).alias("_at"), F.col(value).alias("_held"), F.explode(F.sequence(first, F.col("_next") - 1)).alias(b))
    return each.select(a, b, F.coalesce(F.when(F.col(b) == F.col("_at"), F.col("_held")), F.lit(fill)).alias(value))


def filled(grid: DataFrame, chunks: DataFrame, on: list[str], value: str, fill) -> DataFrame:
    """Every place of the grid with its chunk's value, or ``fill`` where there is none."""
    return grid.join(chunks, on, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def shards(chunks: DataFrame, per_shard: int) -> DataFrame:
    """(array, shard, url, size, inner): shards of ``per_shard`` chunks (array, idx, url, offset, length) of one url each.

    A shard is the file from its start to its last used byte, then 16 bytes of index for each inner chunk.
    """
    shard = F.floor(F.col("idx") / per_shard).cast("bigint")
    got = chunks.withColumn("shard", shard).groupBy("array", "shard").agg(
        F.min("url").alias("url"), F.max("url").alias("_last"), F.max(F.col("offset") + F.col("length")).alias("_end"), F.count("*").alias("inner")
    )
    return got.where("url = _last").select("array", "shard", "url", (F.col("_end") + 16 * per_shard).alias("size"), "inner")


def contiguous_cut(families: DataFrame, allowance: int = 1024) -> DataFrame:
    """(id, q, padding): for n values in parts of k or more, the count q in k..min(2k, n) of a chunk.

    The first q whose last chunk is padded by at most ``allowance`` bytes is taken, else that of least padding.
    families: (id, n, k, width).
    """
    q = F.explode(F.sequence(F.col("k"), F.least(2 * F.col("k"), F.col("n")))).alias("q")
    padded = families.select("id", "n", "k", "width", q).withColumn("padding", (F.pmod(F.col("q") - F.pmod(F.col("n"), F.col("q")), F.col("q")) * F.col("width")).cast("bigint"))
    best = F.min(F.struct((F.col("padding") > allowance).alias("over"), F.when(F.col("padding") > allowance, F.col("padding")).otherwise(F.lit(0)).alias("p"), F.col("q"), F.col("padding")))
    return padded.groupBy("id").agg(best.alias("m")).select("id", "m.q", "m.padding")


def blob_chunks(blobs: DataFrame, most: int = 1 << 24) -> DataFrame:
    """(id, k, start, len): blobs (id, size) cut into the fewest chunks of up to ``most`` bytes, all but the last equal."""
    count = F.greatest(F.ceil(F.col("size") / most), F.lit(1)).cast("bigint")
    width = F.ceil(F.col("size") / count).cast("bigint")
    cut = blobs.select("id", "size", width.alias("w"), F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("k"))
    return cut.select("id", "k", (F.col("k") * F.col("w")).alias("start"), F.least(F.col("w"), F.col("size") - F.col("k") * F.col("w")).alias("len"))


def weighted_mean(cells: DataFrame, by: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """(by, mean): weighted means of the cells with a value; the subset's filter belongs before decoding."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return cells.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(w)).alias("mean"))


def planes(mappings: DataFrame, total: str = "total") -> DataFrame:
    """(image, plane, ifd) from mappings (image, pos, first_plane, first_ifd, count, total): the later mapping wins."""
    n = F.least(F.col("count"), F.col(total) - F.col("first_plane"))
    each = mappings.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    each = each.select("image", (F.col("first_plane") + F.col("k")).alias("plane"), (F.col("first_ifd") + F.col("k")).alias("ifd"), "pos", "k")
    return each.groupBy("image", "plane").agg(F.max_by("ifd", F.struct("pos", "k")).alias("ifd"))


def layers(subblocks: DataFrame, table: DataFrame) -> DataFrame:
    """(id, layer): the first row of ``table`` (ord, value, tolerance) whose band holds a subblock's factor (id, factor)."""
    held = (F.col("factor") >= F.col("value") - F.col("tolerance")) & (F.col("factor") <= F.col("value") + F.col("tolerance"))
    found = subblocks.join(table, held, "left")
    return found.groupBy("id").agg(F.min("ord").alias("layer"))


def level_faults(levels: DataFrame) -> DataFrame:
    """(image, level, fault): levels (image, level, width, height) not strictly smaller than the one before."""
    order = Window.partitionBy("image").orderBy("level")
    bad = (F.col("width") >= F.lag("width").over(order)) | (F.col("height") >= F.lag("height").over(order))
    return levels.select("image", "level", F.when(bad, "size").alias("fault")).where("fault is not null")


def uneven(tiles: DataFrame, by: list[str], like: list[str]) -> DataFrame:
    """(by, kinds): groups whose rows do not all agree in ``like``."""
    return tiles.groupBy(*by).agg(F.count_distinct(F.struct(*like)).alias("kinds")).where("kinds > 1")
