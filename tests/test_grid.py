from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import grid


def test_places_are_filled_without_being_dealt(spark):
    chunks = [(0, 0, 5), (0, 2, 6), (2, 1, None), (3, 2, 7), (4, 0, 8), (1, 9, 9), (-1, 0, 1), (1, -1, 1), (None, 1, 1), (1, None, 1)]
    got = spark.createDataFrame(chunks, "c_x long, c_y long, value long")
    shape = lambda x, y: spark.range(1).select(F.lit(x).cast("bigint").alias("shape_x"), F.lit(8).alias("chunk_x"), F.lit(y).cast("bigint").alias("shape_y"), F.lit(2).alias("chunk_y"))
    filled = grid.filled_plane(shape(30, 5), got, ("x", "y"), "value", -1)
    held = {(x, y): v for x, y, v in chunks if v is not None}
    assert sorted(map(tuple, filled.collect())) == [(x, y, held.get((x, y), -1)) for x in range(4) for y in range(3)]
    for empty in (shape(None, 5), shape(0, 5), shape(30, None), shape(30, 0)):
        assert grid.filled_plane(empty, got, ("x", "y"), "value", -1).count() == 0
    # places come after the last shuffle: what is dealt are chunks and beginnings of rows, in many tasks
    wide = grid.filled_plane(shape(80, 2_000_000), got, ("x", "y"), "value", -1)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert wide.count() == 10_000_000 and wide.where("value >= 0").count() == 5
    assert wide.select(F.spark_partition_id()).distinct().count() > 1
