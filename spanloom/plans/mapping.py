"""The star schema's tables in the shape of stores, trees and grids.  Each view has the same text for DuckDB in ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(c: str, n: int):
    return F.lpad(F.col(c).cast("string"), n, "0")


def objects(spark, d):
    """(key, size, doc_id): documents under their language and source."""
    t = load(spark, d, "documents")
    return t.select(F.concat_ws("/", "lang", "source", _padded("doc_id", 9)).alias("key"), F.octet_length("text").cast("bigint").alias("size"), "doc_id")


def entries(spark, d):
    """(key, kind): orders, references if they have lines; some are hidden."""
    orders, lines = load(spark, d, "orders"), load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_ref", F.lit(True))
    key = F.concat(F.when(F.col("o_orderkey") % 97 == 0, "__vz__/").otherwise("o/"), _padded("o_orderkey", 10))
    return orders.join(lines, "o_orderkey", "left").select(key.alias("key"), F.when(F.col("_ref"), "reference").otherwise("bytes").alias("kind"))


def ranges(spark, d):
    """(key, part, source, offset, length): line items as parts of their order's value."""
    t = load(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return t.select(
        F.concat(F.lit("o/"), _padded("l_orderkey", 10)).alias("key"), (F.row_number().over(order) - 1).cast("bigint").alias("part"),
        F.col("l_suppkey").cast("bigint").alias("source"), (F.col("l_partkey") * 64).cast("bigint").alias("offset"), F.col("l_quantity").cast("bigint").alias("length"),
    )


def sources(spark, d):
    """(idx, size): suppliers."""
    return load(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("idx"), (F.col("s_suppkey") * 40 + 60000).cast("bigint").alias("size"))


def reads(spark, d):
    return ranges(spark, d).select("key", "source", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"))


def text_ranges(spark, d):
    """(key, part, source, offset, length): events of a user as parts of one value over all documents, as long as these."""
    t, docs = load(spark, d, "events"), load(spark, d, "documents")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.broadcast(docs.agg((F.max("doc_id") + 1).alias("n")))  # one row
    asked = t.join(last).select("event_id", "user_id", (F.row_number().over(order) - 1).cast("bigint").alias("part"), F.pmod(F.col("event_id") * 7, F.col("n")).cast("bigint").alias("source"))
    sized = asked.join(docs.select(F.col("doc_id").alias("source"), F.length("text").alias("n")), "source", "left")
    return sized.select(
        F.concat(F.lit("u/"), _padded("user_id", 6)).alias("key"), "part", "source",
        F.coalesce(F.pmod(F.col("event_id") * 7919, F.greatest("n", F.lit(1))), F.lit(0)).cast("bigint").alias("offset"), (F.pmod("event_id", F.lit(9)) + 1).cast("bigint").alias("length"),
    )


def elements(spark, d):
    """(id, parent, name, start, len): regions, nations, customers and their orders under one root."""
    r, n, c, o = (load(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    zero = F.lit(0).cast("bigint")
    big = lambda c: F.col(c).cast("bigint")
    root = spark.range(1).select(zero.alias("id"), F.lit(None).cast("bigint").alias("parent"), F.lit("root").alias("name"), zero.alias("start"), zero.alias("len"))
    rs = r.select((big("r_regionkey") + 1).alias("id"), zero.alias("parent"), F.col("r_name").alias("name"), zero.alias("start"), zero.alias("len"))
    ns = n.select((big("n_nationkey") + 1000).alias("id"), (big("n_regionkey") + 1).alias("parent"), F.col("n_name").alias("name"), zero.alias("start"), zero.alias("len"))
    cs = c.select((big("c_custkey") + 1000000).alias("id"), (big("c_nationkey") + 1000).alias("parent"), F.col("c_mktsegment").alias("name"), zero.alias("start"), zero.alias("len"))
    os_ = o.select(
        (big("o_orderkey") + 1000000000).alias("id"), (big("o_custkey") + 1000000).alias("parent"), F.col("o_orderpriority").alias("name"),
        F.pmod(big("o_orderkey") * 7919, F.lit(1000003)).alias("start"), (F.pmod(big("o_orderkey"), F.lit(5)) * 10).cast("bigint").alias("len"),
    )
    return root.unionByName(rs).unionByName(ns).unionByName(cs).unionByName(os_)


def leaves(spark, d):
    """(space, id, start, len): extents of parts in suppliers' spaces."""
    t = load(spark, d, "lineitem")
    return t.groupBy(F.col("l_suppkey").cast("bigint").alias("space"), (F.col("l_partkey") * 10).cast("bigint").alias("start")).agg(
        F.max(F.col("l_quantity").cast("bigint")).alias("len"), F.min(F.col("l_orderkey")).cast("bigint").alias("id")
    )


def spaces(spark, d):
    """(space, size): suppliers' spaces, a little longer than the furthest part."""
    last = F.broadcast(load(spark, d, "part").agg((F.max("p_partkey") * 10 + 100).cast("bigint").alias("size")))  # one row
    return load(spark, d, "supplier").join(last).select(F.col("s_suppkey").cast("bigint").alias("space"), "size")


def cells(spark, d):
    """(x, y, value, weight, flag): parts sold by suppliers on a grid."""
    t = load(spark, d, "lineitem")
    return t.select(
        F.col("l_partkey").cast("bigint").alias("x"), F.col("l_suppkey").cast("bigint").alias("y"), F.col("l_quantity").cast("bigint").alias("value"), F.col("l_linenumber").cast("bigint").alias("weight"), F.col("l_returnflag").alias("flag"),
    )


SQL = {
    "objects": "SELECT lang || '/' || source || '/' || lpad(cast(doc_id AS varchar), 9, '0') AS key, cast(strlen(text) AS bigint) AS size, doc_id FROM documents",
    "entries": "SELECT CASE WHEN o_orderkey % 97 = 0 THEN '__vz__/' ELSE 'o/' END || lpad(cast(o_orderkey AS varchar), 10, '0') AS key, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'reference' ELSE 'bytes' END AS kind FROM orders",
    "ranges": "SELECT 'o/' || lpad(cast(l_orderkey AS varchar), 10, '0') AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS part, cast(l_suppkey AS bigint) AS source, cast(l_partkey * 64 AS bigint) AS \"offset\", cast(l_quantity AS bigint) AS length FROM lineitem",
    "sources": "SELECT cast(s_suppkey AS bigint) AS idx, cast(s_suppkey * 40 + 60000 AS bigint) AS size FROM supplier",
    "reads": "SELECT key, source, \"offset\" AS start, \"offset\" + length AS stop FROM ranges",
    "text_ranges": "SELECT 'u/' || lpad(cast(user_id AS varchar), 6, '0') AS key, part, source, cast(coalesce(event_id * 7919 % greatest(length(text), 1), 0) AS bigint) AS \"offset\", cast(event_id % 9 + 1 AS bigint) AS length FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS part, cast(event_id * 7 % (SELECT max(doc_id) + 1 FROM documents) AS bigint) AS source FROM events) e LEFT JOIN (SELECT doc_id, text FROM documents) t ON t.doc_id = e.source",
    "elements": "SELECT 0::bigint AS id, NULL::bigint AS parent, 'root' AS name, 0::bigint AS start, 0::bigint AS len UNION ALL SELECT r_regionkey + 1, 0, r_name, 0, 0 FROM region UNION ALL SELECT n_nationkey + 1000, n_regionkey + 1, n_name, 0, 0 FROM nation UNION ALL SELECT c_custkey + 1000000, c_nationkey + 1000, c_mktsegment, 0, 0 FROM customer UNION ALL SELECT o_orderkey + 1000000000, o_custkey + 1000000, o_orderpriority, o_orderkey * 7919 % 1000003, o_orderkey % 5 * 10 FROM orders",
    "leaves": "SELECT cast(l_suppkey AS bigint) AS space, cast(l_partkey * 10 AS bigint) AS start, max(cast(l_quantity AS bigint)) AS len, cast(min(l_orderkey) AS bigint) AS id FROM lineitem GROUP BY 1, 2",
    "spaces": "SELECT cast(s_suppkey AS bigint) AS space, cast((SELECT max(p_partkey) * 10 + 100 FROM part) AS bigint) AS size FROM supplier",
    "cells": "SELECT cast(l_partkey AS bigint) AS x, cast(l_suppkey AS bigint) AS y, cast(l_quantity AS bigint) AS value, cast(l_linenumber AS bigint) AS weight, l_returnflag AS flag FROM lineitem",
}
_NEEDS = {"reads": ("ranges",)}


def sql(text: str, *views: str) -> str:
    """A statement for DuckDB over the named views."""
    names = []
    for v in views:
        names += [n for n in (*_NEEDS.get(v, ()), v) if n not in names]
    text = text.strip()
    own = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    recursive = text.upper().startswith("WITH RECURSIVE ")
    if recursive:
        return f"WITH RECURSIVE {own + ', ' if own else ''}{text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {own + ', ' if own else ''}{text[5:]}"
    return f"WITH {own} {text}" if own else text
