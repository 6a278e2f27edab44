"""SimHash near-duplicates by deletion-variant signatures (operator 8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .components import connected_components

SEED = 42


def fingerprint_of(text: bytes | None, width: int = 3) -> int:
    """64 majority bits over the XXH64 of all ``width``-word shingles; 0 for no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        set_bits += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


#: A bucket of one key with more distinct fingerprints than this is cut further instead of compared in pairs.
WIDE_BUCKET = 256


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of ``docs``; a null or blank text has fingerprint 0."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col).cast("binary")).alias("fp"))


def _half(fp, seg: int):
    return F.shiftrightunsigned(fp, 32 * seg).bitwiseAND(0xFFFFFFFF)


def links(fps: DataFrame, wide: int = WIDE_BUCKET) -> DataFrame:
    """(u, v): distinct values of column ``fp`` at 2 or fewer differing bits, enough of them to join all linked.

    A fingerprint is cut into two halves.  If two differ in at most 2 bits, one half differs in at most one, so
    they share that half with one bit deleted: each half gives 32 one-wildcard variants, which are joined for
    equality and verified.  Every link of a bucket of at most ``wide`` values is returned.  In wider buckets the
    other half is cut as well: equal variants there (one wildcard in each half, or two in the other half of
    values that share this one) hold at most four values, all linked, which are chained to the least.
    """
    # each row becomes 64: small partitions of them, however few bytes they have
    parts = 2 * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = fps.select("fp").distinct().repartition(parts, "fp").select("fp", _half(F.col("fp"), 0).alias("h0"), _half(F.col("fp"), 1).alias("h1"))
    keys = base.select(
        "fp", "h0", "h1", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot")
    ).select(
        "fp",
        F.expr("shiftleft(cast(slot as bigint), 32) | (if(slot < 32, h0, h1) & ~shiftleft(1L, slot % 32))").alias("key"),
    )
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stash(sizes, "buckets")
    usual = keys.join(sizes.where(F.col("n") <= wide).select("key"), "key", "left_semi")
    usual = stash(usual, "members")
    a, b = usual.select("key", F.col("fp").alias("u")), usual.select("key", F.col("fp").alias("v"))
    pairs = a.join(b, "key").where("u < v and bit_count(u ^ v) <= 2").select("u", "v").distinct()
    hot = keys.join(sizes.where(F.col("n") > wide).select("key"), "key", "left_semi").select(
        "fp", "key", F.expr("if(key < shiftleft(32L, 32), shiftrightunsigned(fp, 32), fp & 4294967295L)").alias("other"),
        F.expr("if(key < shiftleft(32L, 32), fp & 4294967295L, shiftrightunsigned(fp, 32))").alias("own"),
    )
    one = hot.select(
        "fp", "key", "other", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")
    ).select("fp", "key", F.expr("shiftleft(cast(i as bigint), 32) | (other & ~shiftleft(1L, i))").alias("rest"))
    two = (
        hot.where("shiftrightunsigned(key, 32) % 32 = 0")
        .select("fp", "key", "own", "other", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
        .select("fp", "key", "own", "other", "i", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
        .where("i < j")
        .select(
            "fp",
            F.expr("shiftleft(-1L - (i * 32 + j), 33) | (shiftleft(shiftrightunsigned(key, 37), 32)) | own").alias("key"),
            F.expr("other & ~shiftleft(1L, i) & ~shiftleft(1L, j)").alias("rest"),
        )
    )
    cliques = (
        one.unionByName(two).groupBy("key", "rest").agg(F.collect_set("fp").alias("m")).where("size(m) > 1")
        .select(F.array_min("m").alias("u"), F.explode("m").alias("v")).where("u <> v").distinct()
    )
    return pairs.unionByName(cliques).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: int = WIDE_BUCKET) -> DataFrame:
    """(id, fp, component): component is the least id that links of 2 or fewer bits reach.

    One row per row of ``docs``.  Equal fingerprints are linked, the zero of blank and null texts too.  Rows
    that repeat an id are told apart by their text alone.  A null id stays and is never a component's name
    unless nothing else is in it; an empty table gives an empty one; other columns are not looked at.
    """
    rows = stash(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = stash(rows.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    linked = connected_components(links(reps, wide)).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    linked = stash(linked.join(reps, "fp"), "linked")
    # kept apart, so that Spark can split the rows of a large component
    least = stash(linked.groupBy("root").agg(F.min("rep").alias("component")), "least")
    linked = linked.join(least, "root").select("fp", "component")
    named = reps.join(linked, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return rows.join(named, "fp").select("id", "fp", "component")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
