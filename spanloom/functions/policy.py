"""Which urls may be read, as Columns."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: address blocks by class; all others are public
CLASSES = {
    "loopback": ("127.0.0.0/8", "::1/128"),
    "private": ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7"),
    "link-local": ("169.254.0.0/16", "fe80::/10"),
    "special": (
        "0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3",
        "::/8", "64:ff9b:1::/48", "100::/63", "2001::/23", "2001:db8::/32", "3fff::/20", "5f00::/16", "fec0::/10", "ff00::/8",
    ),
}
# fixed values: blocks of IPv6 addresses that hold an IPv4 address, and the hex digit at which that begins
EMBEDDED = {"::ffff:0:0/96": 24, "64:ff9b::/96": 24, "2002::/16": 4}


def blocks(version: int) -> list[tuple[str, ipaddress.IPv4Network | ipaddress.IPv6Network]]:
    nets = [(name, ipaddress.ip_network(block)) for name, some in CLASSES.items() for block in some]
    return [(name, net) for name, net in nets if net.version == version]


def _first_that_holds(at: Column, bounds) -> Column:
    out = F.lit("public")
    for name, lo, hi in reversed(bounds):
        out = F.when(at.between(lo, hi), name).otherwise(out)
    return out


def address_class(address: Column) -> Column:
    """The class of an IPv4 address given as a number.  A few comparisons, no join."""
    return _first_that_holds(address, [(name, int(net[0]), int(net[-1])) for name, net in blocks(4)])


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def v4_number(text: Column) -> Column:
    """A dotted IPv4 literal as a number, null if it is none."""
    value = lambda parts: F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, x: n * 256 + x.try_cast("bigint"))
    return F.when(text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), value(F.split(text, r"\.")))


def _v6_groups(text: Column) -> Column:
    """The literal with a dotted end written as two groups; null if that end is no address."""
    tail = F.regexp_extract(text, r"^.*:([0-9.]*\.[0-9.]*)$", 1)
    half = lambda n: F.lower(F.hex(n.cast("bigint")))
    as_groups = lambda n: F.concat_ws(":", half(F.floor(n / 65536)), half(n % 65536))
    return _let(tail, lambda t: F.when(t == "", text).otherwise(_let(v4_number(t), lambda n: F.when(n.isNotNull(), F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(t)), as_groups(n))))))


def _v6_whole(groups: Column) -> Column:
    """All eight groups; null if there are more or fewer."""
    listed = lambda s: F.filter(F.split(s, ":", -1), lambda g: s != "")
    sides = F.split(groups, "::", -1)
    joined = lambda a, b: F.when(F.size(a) + F.size(b) < 8, F.concat(a, F.array_repeat(F.lit("0"), 8 - F.size(a) - F.size(b)), b))
    open_ = _let(sides, lambda p: _let(listed(F.get(p, F.lit(0))), lambda a: _let(listed(F.get(p, F.lit(1))), lambda b: joined(a, b))))
    full = _let(listed(groups), lambda g: F.when(F.size(g) == 8, g))
    return F.when(groups.contains(":::"), None).when(F.size(sides) == 2, open_).when(F.size(sides) == 1, full)


def v6_digits(text: Column) -> Column:
    """An IPv6 literal as 32 hex digits, null if it is none.  A zone after ``%`` does not count."""
    bare = F.lower(F.regexp_replace(text, "%.*$", ""))
    digits = lambda w: F.when(F.forall(w, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(w, lambda g: F.lpad(g, 4, "0")), ""))
    return _let(bare, lambda t: _let(_v6_groups(t), lambda g: _let(_v6_whole(g), digits)))


def _hex(net, k: int) -> str:
    return f"{int(net[k]):032x}"


def v6_class(digits: Column) -> Column:
    """The class of an IPv6 address given as 32 hex digits: that of the IPv4 address which it holds, if any."""
    held = F.lit(None).cast("bigint")
    for block, at in EMBEDDED.items():
        net = ipaddress.ip_network(block)
        held = F.when(digits.between(_hex(net, 0), _hex(net, -1)), F.conv(F.substring(digits, at + 1, 8), 16, 10).cast("bigint")).otherwise(held)
    own = _first_that_holds(digits, [(name, _hex(net, 0), _hex(net, -1)) for name, net in blocks(6)])
    return _let(held, lambda n: F.when(n.isNotNull(), address_class(n)).otherwise(own))


def host_class(host: Column) -> Column:
    """Literal addresses by their class, localhost and names under it as loopback; null for names to be resolved."""
    name = F.regexp_replace(F.regexp_replace(F.lower(host), r"\.+$", ""), r"^\[(.*)\]$", "$1")
    four = lambda n: _let(v4_number(F.regexp_replace(n, "%.*$", "")), lambda x: F.when(x.isNotNull(), address_class(x)))
    six = lambda n: _let(v6_digits(n), lambda x: F.when(x.isNotNull(), v6_class(x)))
    return _let(name, lambda n: F.when((n == "localhost") | n.endswith(".localhost"), "loopback").otherwise(F.coalesce(four(n), six(n))))


def scheme_allowed(url: Column, store_is_local: bool) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return scheme.isin("http", "https") | ((scheme == "file") & F.lit(store_is_local))


def has_prefix(url: Column, prefix: Column) -> Column:
    """Whether a url lies under a prefix, at a boundary; paths with encoded dots, slashes or backslashes never match."""
    after = F.substring(url, F.length(prefix) + 1, F.lit(1))
    under = url.startswith(prefix) & (prefix.endswith("/") | (after == "") | after.isin("/", "?", "#"))
    return under & ~F.regexp_extract(url, "^[^?#]*", 0).rlike("%(2[eEfF]|5[cC])")


def allowed_by(url: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | has_prefix(url, F.lit(p))
    return out


def public_object_url(url: Column) -> Column:
    """s3://bucket/key as the https address of a public bucket; null for other urls and for names that no host can carry."""
    shape = r"^[sS]3://([a-z0-9][a-z0-9-]*[a-z0-9])(/[^\n]*)?$"
    path = F.regexp_extract(url, shape, 2)
    return F.when(url.rlike(shape), F.concat(F.lit("https://"), F.regexp_extract(url, shape, 1), F.lit(".s3.amazonaws.com"), F.when(path == "", "/").otherwise(path)))


def rewritten(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``urls`` with ``to``: the longest matching prefix replaced."""
    out = F.col(url)
    for old, new in sorted(rules, key=lambda r: len(r[0])):  # the longest is outermost, so it wins
        out = F.when(F.col(url).startswith(old), F.concat(F.lit(new), F.substring(F.col(url), F.lit(len(old) + 1), F.length(url)))).otherwise(out)
    return urls.withColumn("to", out)


def strong_etag(etag: Column) -> Column:
    return etag.rlike('^"[\\x21\\x23-\\x7e]*"$')
