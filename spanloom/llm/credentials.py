"""Secret scans with corpus-wide ownership (operator 7), with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, text_or_empty
from .spans import of_kind, told, with_matches

KINDS = ("assign", "access", "hex")
_VALUE = "[A-Za-z0-9+/_.=-]"
_ASSIGN = rf"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({_VALUE}++)"""
#: Runs are taken only where they begin, so that long texts of such characters take linear time.
PATTERNS = {"assign": _ASSIGN, "access": r"AKIA[A-Z0-9]{16,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+"}
#: Words that may repeat a known credential without a name before it: all that an assigned value may be.
BARE = rf"(?<!{_VALUE}){_VALUE}{{6,}}+"
#: A value that so many owners have is a copied example, however many repositories of one owner have it.
EXAMPLE_OWNERS = 3


def _value(kind: str, m: Column) -> Column:
    return F.regexp_extract(m, _ASSIGN, 2) if kind == "assign" else m


def _undotted(m: Column) -> Column:
    """The value without a sentence's full stops after it."""
    return F.rtrim(m, F.lit("."))


def _hashed(name: str) -> Column:
    return F.transform(name, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(_undotted(_value(name, x["match"]))).alias("value")))


def _hashed_words() -> Column:
    """Bare words; ``plain`` ones have no digit and may be ordinary words."""
    return F.transform("bare", lambda x: F.struct(
        x["start"].alias("start"), (x["start"] + F.length(_undotted(x["match"]))).alias("end"), F.xxhash64(_undotted(x["match"])).alias("value"), (~x["match"].rlike("[0-9]")).alias("plain"),
    ))


def _scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(owner_col).alias("owner"), text_or_empty(text_col).alias("text"))
    # what each kind needs, found faster than the kind itself
    some = {"assign": F.col("text").rlike("(?i)pass|secret|token|api"), "access": F.contains("text", F.lit("AKIA")), "hex": F.col("text").rlike("[0-9a-f]{24}")}
    for kind in KINDS:
        rows = with_matches(rows, kind, "text", PATTERNS[kind], some[kind], near=0)
    rows = rows.withColumn("assign", F.filter("assign", lambda x: F.length(_value("assign", x["match"])) >= 6))
    rows = with_matches(rows, "bare", "text", BARE, near=0).drop("text")
    for name in KINDS:
        rows = rows.withColumn(name, _hashed(name))
    return rows.withColumn("bare", _hashed_words())


def ownership(values: DataFrame) -> DataFrame:
    """(value, repositories, owners, example) from (value, row, owner): how widely each candidate is copied.

    Counts are of distinct rows and distinct non-null owners, summed up in two steps, so that a value that is
    in a third of all rows is counted in many tasks first.
    """
    by_owner = values.distinct().groupBy("value", "owner").agg(F.count("*").alias("n"))
    wide = by_owner.groupBy("value").agg(F.sum("n").alias("repositories"), F.count("owner").alias("owners"))
    return wide.withColumn("example", F.col("owners") >= EXAMPLE_OWNERS)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base, spans, n_live, n_example) for each row of ``docs``.

    A repository is a row, its owner is ``owner_col``.  Base matches give candidate values.  Those that few
    owners have look live; where such a value stands elsewhere without a name before it and
    outside base spans, that place is added as a span of its kind, with or without a full stop after it.  Only where
    a value without a digit stands bare with ``EXAMPLE_OWNERS`` owners or more is it an ordinary word and not added.  n_live and n_example count base matches
    by what their value is.  Spans are (start, kind, end) in code points, the end exclusive, kind an index of
    KINDS; a value that several kinds have is of the first.  Very long texts are searched whole; other columns are not
    read.  A null text is empty, a null owner is no owner; repeated rows are repositories each; an empty
    table gives an empty one.
    """
    scanned = stash(_scan(docs, id_col, text_col, owner_col), "matches")
    parts = [scanned.select("row", "owner", F.lit(k).alias("kind"), F.explode(kind).alias("x")) for k, kind in enumerate(KINDS)]
    base = parts[0].union(parts[1]).union(parts[2]).select("row", "owner", "kind", F.col("x.value").alias("value"))
    base = stash(base, "candidates")
    owned = stash(ownership(base.select("value", "row", "owner")).join(base.groupBy("value").agg(F.min("kind").alias("kind")), "value"), "ownership")
    counts = base.join(owned.select("value", "example"), "value").groupBy("row").agg(
        F.count(F.when(~F.col("example"), 1)).alias("n_live"), F.count(F.when(F.col("example"), 1)).alias("n_example")
    )
    bare = scanned.select("row", "owner", F.explode("bare").alias("x")).select("row", "owner", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.value").alias("value"), F.col("x.plain").alias("plain"))
    places = stash(bare.join(owned.where("not example").select("value", "kind"), "value"), "places")
    ordinary = places.where("plain").select("value", "owner").distinct().groupBy("value").agg(F.count("owner").alias("owners")).where(F.col("owners") >= EXAMPLE_OWNERS)
    new = places.join(ordinary.select("value"), "value", "left_anti").groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("new"))
    spans = F.array_sort(F.concat(*(of_kind(F.col(kind), k) for k, kind in enumerate(KINDS))))
    rows = scanned.select("id", "row", spans.alias("base"), *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS))
    rows = rows.join(counts, "row", "left").join(new, "row", "left")
    clear = F.filter(F.coalesce("new", F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")), lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return rows.select(
        "id", *(f"n_{kind}" for kind in KINDS), "base", F.array_sort(F.concat("base", clear)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"), *(f"n_{kind}" for kind in KINDS), F.sha2(told(F.col("base"), KINDS), 256).alias("base_sha256"), told(F.col("spans"), KINDS).alias("spans"), "n_live", "n_example",
    )
