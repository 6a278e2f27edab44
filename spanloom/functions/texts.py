"""Names, numbers, dates, units and texts as sources write them, as Columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The index of a name that has none.
NO_INDEX = (1 << 64) - 1
# fixed values: names of node documents, symbols of units, and lengths of units in metres
_NODE = r"^(?:zarr\.json|\.zarray|\.zgroup)~*$"
UNITS = {
    "µm": "micrometer", "μm": "micrometer", "um": "micrometer", "nm": "nanometer", "mm": "millimeter", "cm": "centimeter", "m": "meter", "Å": "angstrom", "Å": "angstrom",
    "pm": "picometer", "in": "inch", "ft": "foot", "s": "second", "ms": "millisecond", "min": "minute", "h": "hour",
}
METRES = {"micrometer": 1e-6, "nanometer": 1e-9, "millimeter": 1e-3, "centimeter": 1e-2, "meter": 1.0, "angstrom": 1e-10, "picometer": 1e-12, "inch": 0.0254, "foot": 0.3048}
_ESCAPES = (("%", "%25"), ("/", "%2F"), ("~", "%7E"))
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def escaped(text: Column) -> Column:
    """``%``, ``/`` and ``~`` percent-encoded."""
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _index(n) -> Column:
    return (n if isinstance(n, Column) else F.lit(str(n))).cast("decimal(20,0)")


def source_names(texts: DataFrame, fixed: tuple[str, ...] = ()) -> DataFrame:
    """``texts`` (parent, pos, text) with ``name`` and ``idx``: full names of siblings that the source names.

    The first of a parent's equal texts is its own name, without an index, if it is not empty, holds no ``/`` or ``~``
    and is no fixed name; any other is the escaped text and ``~``, numbered by the equal texts before it.
    """
    earlier = F.row_number().over(Window.partitionBy("parent", "text").orderBy("pos")) - 1
    plain = (F.col("text") != "") & ~F.col("text").rlike("[/~]") & ~F.col("text").isin(*fixed) & (F.col("_k") == 0)
    out = texts.withColumn("_k", earlier)
    name = F.when(plain, F.col("text")).otherwise(F.concat(escaped(F.col("text")), F.lit("~")))
    return out.withColumn("name", name).withColumn("idx", F.when(plain, _index(NO_INDEX)).otherwise(_index(F.col("_k")))).drop("_k")


def source_text(name: Column, idx: Column) -> Column:
    """The text that ``source_names`` named."""
    return F.when(name.endswith("~") & (idx != _index(NO_INDEX)), unescaped(F.substring(name, F.lit(1), F.length(name) - 1))).otherwise(name)


def key_name(segment: Column, shadowed: Column) -> Column:
    """(name, idx) of a key's segment: a last number becomes the index; segments with ``~``, and those that are both an
    object and a directory (``shadowed``), are escaped and end in ``~``."""
    number = F.regexp_extract(segment, r"(0|[1-9][0-9]*)$", 1)
    folds = (number != "") & (F.length(number) <= 20) & (number.try_cast("decimal(20,0)") < _index(NO_INDEX))
    odd = shadowed | segment.contains("~")
    return F.struct(
        F.when(odd, F.concat(escaped(segment), F.lit("~"))).when(folds, F.substring(segment, F.lit(1), F.length(segment) - F.length(number))).otherwise(segment).alias("name"),
        F.when(odd, _index(shadowed.cast("int"))).when(folds, number.try_cast("decimal(20,0)")).otherwise(_index(NO_INDEX)).alias("idx"),
    )


def key_segment(name: Column, idx: Column) -> Column:
    """The segment that ``key_name`` named."""
    odd = name.endswith("~") & (idx <= 1)
    return F.when(odd, unescaped(F.substring(name, F.lit(1), F.length(name) - 1))).when(idx == _index(NO_INDEX), name).otherwise(F.concat(name, idx.cast("string")))


def object_key(key: Column, under: str) -> Column:
    """Where a store's other object goes, ``under`` a prefix of the format's: names that a reader takes for a node's document get one more ``~``."""
    last = F.substring_index(key, "/", -1)
    return F.concat(F.lit(under), key, F.when(last.rlike(_NODE), "~").otherwise(""))


def integer(data: Column, little: bool = True, signed: bool = False) -> Column:
    """The integer of up to eight bytes, as decimal(20,0)."""
    digits = F.hex(data)
    if little:
        pairs = F.regexp_extract_all(digits, F.lit("(..)"), 1)
        digits = F.array_join(F.reverse(pairs), "")
    value = F.conv(digits, 16, 10).cast("decimal(20,0)")
    if signed:
        size = F.get(F.array(*(F.lit(str(256**n)).cast("decimal(20,0)") for n in range(9))), F.octet_length(data))
        value = F.when(F.conv(F.substring(digits, 1, 2), 16, 10).cast("int") >= 128, value - size).otherwise(value).cast("decimal(20,0)")
    return value


def guid(data: Column) -> Column:
    """The text of a GUID of 16 bytes: three little-endian fields, then bytes in order."""
    pairs = F.regexp_extract_all(F.lower(F.hex(data)), F.lit("(..)"), 1)
    part = lambda a, n: F.array_join(F.slice(pairs, a, n), "")
    turned = lambda a, n: F.array_join(F.reverse(F.slice(pairs, a, n)), "")
    return F.when(F.octet_length(data) == 16, F.concat_ws("-", turned(1, 4), turned(5, 2), turned(7, 2), part(9, 2), part(11, 6)))


def cstr(data: Column) -> Column:
    """The text before the first zero byte, as Latin-1."""
    return F.split_part(F.decode(data, "ISO-8859-1"), F.lit("\0"), F.lit(1))


def utf16(data: Column, little: bool = True) -> Column:
    return F.decode(data, "UTF-16LE" if little else "UTF-16BE")


def _seconds(y, mo, d, h, mi, s) -> Column:
    """Seconds since 1970 of a time in UTC, null if there is no such day."""
    day = F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd")
    return F.when((h.cast("int") < 24) & (mi.cast("int") < 60), F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + h.cast("int") * 3600 + mi.cast("int") * 60 + s)


def imf_fixdate(text: Column) -> Column:
    """Seconds since the epoch of ``Sun, 06 Nov 1994 08:49:37 GMT``, null if it is none; a leap second is the next one."""
    form = r"^([A-Z][a-z]{2}), ([0-9]{2}) ([A-Z][a-z]{2}) ([0-9]{4}) ([0-9]{2}):([0-9]{2}):([0-9]{2}) GMT$"
    g = lambda k: F.regexp_extract(text, form, k)
    months = F.create_map(*chain.from_iterable((F.lit(m), F.lit(f"{k:02d}")) for k, m in enumerate(_MONTHS, 1)))
    month = F.try_element_at(months, g(3))
    day = F.try_to_date(F.concat_ws("-", g(4), F.coalesce(month, F.lit("00")), g(2)), "yyyy-MM-dd")
    ok = text.rlike(form) & month.isNotNull() & (F.date_format(day, "EEE") == g(1)) & (g(7).try_cast("int") <= 60)
    return F.when(ok, _seconds(g(4), month, g(2), g(5), g(6), g(7).cast("int")))


def to_imf_fixdate(seconds: Column) -> Column:
    """The HTTP date of seconds since the epoch, null outside of the years 1 to 9999; the session's zone is UTC."""
    return F.when(seconds.between(-62135596800, 253402300799), F.concat(F.date_format(F.timestamp_seconds(seconds), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))


def time_point(text: Column) -> Column:
    """(seconds, fraction) of ``1994-11-06 08:49:37.25``; null if it is none."""
    form = r"^([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?$"
    g = lambda k: F.regexp_extract(text, form, k)
    whole = F.when(text.rlike(form) & (g(6).try_cast("int") < 60), _seconds(g(1), g(2), g(3), g(4), g(5), g(6).cast("int")))
    return F.when(whole.isNotNull(), F.struct(whole.alias("seconds"), F.concat(F.lit("0."), F.when(g(7) == "", "0").otherwise(g(7))).cast("double").alias("fraction")))


def unit(symbol: Column) -> Column:
    """The name of a unit's symbol, null for any other."""
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in UNITS.items())), symbol)


def length_in(value: Column, of: Column, to: Column) -> Column:
    """A length of unit ``of`` in unit ``to``; null unless both are lengths."""
    metres = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in METRES.items()))
    return value * (F.try_element_at(metres, of) / F.try_element_at(metres, to))


def centred(centre: Column, size: Column, scale: Column) -> Column:
    """The translation of an axis of ``size`` cells whose middle is at ``centre``."""
    return centre - size * scale / 2


def colour(red: Column, green: Column, blue: Column) -> Column:
    """Six hex digits of a colour whose shares are from 0 to 1."""
    return F.concat(*(F.lpad(F.hex(F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("bigint")), 2, "0") for c in (red, green, blue)))


def greatest_divisor(numbers: Column) -> Column:
    """The greatest common divisor of an array of longs, 0 of none."""
    # a remainder is less than half of the number before the last, so 92 steps end for any two longs
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b")))
    two = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.abs(a).cast("bigint").alias("a"), F.abs(b).cast("bigint").alias("b")), step)["a"]
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, b: two(a, b))


def fnv1a(data: Column) -> Column:
    """The 64-bit FNV-1a digest of bytes, as 16 hex digits."""
    at = F.sequence(F.lit(1), F.octet_length(data))
    wrap = lambda x: F.pmod(x, F.expr("cast(18446744073709551616 as decimal(38,0))")).cast("decimal(20,0)")
    # the prime is 2**40 + 435; halves keep products below 38 digits
    high, low = (lambda h: F.floor(h / F.expr("cast(4294967296 as decimal(20,0))")).cast("decimal(20,0)")), (lambda h: F.pmod(h, F.expr("cast(4294967296 as decimal(20,0))")).cast("bigint"))

    def eat(h, k):
        byte = F.conv(F.hex(F.substring(data, k, F.lit(1))), 16, 10).cast("int")
        mixed = F.struct(high(h).cast("bigint").alias("hi"), low(h).bitwiseXOR(byte.cast("bigint")).alias("lo"))
        # (hi * 2**32 + lo) * (2**40 + 435) mod 2**64
        out = (mixed["lo"] % (1 << 24)).cast("decimal(38,0)") * F.lit(1 << 40) + mixed["lo"].cast("decimal(38,0)") * F.lit(435) + ((mixed["hi"] * 435) % (1 << 32)).cast("decimal(38,0)") * F.lit(1 << 32)
        return wrap(out)

    done = F.aggregate(F.when(F.octet_length(data) > 0, at).otherwise(F.expr("cast(array() as array<int>)")), F.expr("cast(14695981039346656037 as decimal(20,0))"), eat)
    return F.lower(F.concat(F.lpad(F.hex(high(done).cast("bigint")), 8, "0"), F.lpad(F.hex(low(done)), 8, "0")))
