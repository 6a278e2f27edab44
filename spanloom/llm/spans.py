"""Places of regular expressions in texts, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are summed in one go, so that running sums of long arrays stay near linear.
CHUNK = 128


def _longs():
    return F.expr("cast(array() as array<bigint>)")


def running_sums(numbers: Column) -> Column:
    """For each element of an array of longs the sum of those before it."""
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / CHUNK).cast("int")), lambda c: F.slice(numbers, c * CHUNK + 1, CHUNK)
    )
    inner = F.transform(
        chunks,
        lambda chunk: F.aggregate(
            chunk,
            F.struct(F.lit(0).cast("long").alias("s"), _longs().alias("a")),
            lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")),
        ),
    )
    outer = F.aggregate(
        inner,
        F.struct(F.lit(0).cast("long").alias("s"), F.expr("cast(array() as array<array<bigint>>)").alias("a")),
        lambda acc, x: F.struct((acc["s"] + x["s"]).alias("s"), F.concat(acc["a"], F.array(F.transform(x["a"], lambda v: v + acc["s"]))).alias("a")),
    )
    return F.when(F.size(numbers) > 0, F.flatten(outer["a"])).otherwise(_longs())


#: Characters before and after a match in which its context is looked for.
NEAR = 96


def with_matches(df, name: str, text: str, pattern: str, only_if: Column | None = None, near: int = NEAR):
    """``df`` with column ``name``: an array of (start, end, match, before, after) of the pattern's matches in column ``text``.

    Matches are leftmost and do not overlap; places are code points, the end exclusive.  before and after are the
    ``near`` characters next to the match, or fewer if the text or another match is nearer; 0 leaves them out.  Texts for which
    ``only_if`` does not hold have none.
    """
    gaps, found, sizes, starts = (f"_{name}_{x}" for x in ("gaps", "found", "sizes", "starts"))
    quick = (lambda c, none: F.when(only_if, c).otherwise(F.expr(none))) if only_if is not None else (lambda c, none: c)
    out = df.withColumn(found, quick(F.regexp_extract_all(text, F.lit(pattern), 0), "cast(array() as array<string>)"))
    some = F.size(found) > 0
    out = out.withColumn(gaps, F.when(some, F.split(text, pattern, -1)).otherwise(F.expr("cast(array() as array<string>)")))
    out = out.withColumn(sizes, F.zip_with(gaps, found, lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("long")))
    out = out.withColumn(starts, F.when(some, running_sums(F.col(sizes))).otherwise(_longs()))
    after = F.when(some, F.slice(gaps, F.lit(2), F.size(found))).otherwise(F.expr("cast(array() as array<string>)"))
    spans = F.transform(
        F.filter(F.arrays_zip(F.col(found).alias("m"), F.col(gaps).alias("g"), *([after.alias("n")] if near else []), F.col(starts).alias("s")), lambda x: x["m"].isNotNull()),
        lambda x: F.struct(
            (x["s"] + F.length(x["g"])).alias("start"), (x["s"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["m"].alias("match"),
            *((F.substring(x["g"], -near, near).alias("before"), F.substring(x["n"], 1, near).alias("after")) if near else ()),
        ),
    )
    return out.withColumn(name, spans).drop(gaps, found, sizes, starts)


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Scripts without spaces: each of their characters is a word.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[{_UNSPACED}]|[\p{{L}}\p{{M}}&&[^{_UNSPACED}]]+"


def contexts(before: Column, after: Column) -> Column:
    """Hashes of the patterns around a place: one to three words before it, two or three after it, one on each side.

    Words are runs of letters in lower case.  A single word after a place says too little by itself.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)
    some = lambda side, w, n: F.when(F.size(w) >= n, F.xxhash64(F.lit(side), *(F.get(w, F.lit(k)) for k in range(n))))
    both = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.xxhash64(F.lit("both"), F.get(a, F.lit(0)), F.get(b, F.lit(0))))
    every = lambda a, b: F.array_compact(F.array(*(some("before", a, n) for n in (1, 2, 3)), *(some("after", b, n) for n in (2, 3)), both(a, b)))
    return let(F.reverse(words(before)), lambda a: let(words(after), lambda b: every(a, b)))


def told(spans: Column, kinds) -> Column:
    """``kind:start:end`` of an array of (start, kind, end) in order, comma-joined; kind is an index of ``kinds``."""
    names = F.array(*(F.lit(k) for k in kinds))
    one = F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(one, ",")


def of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
