"""JSON documents, read strictly: no BOM, NaN, trailing text or comma; bounded size and depth."""

from __future__ import annotations

import json

MAX_BYTES, MAX_DEPTH = 1 << 24, 256


class Rejected(ValueError):
    """An input that a profile does not take."""


def parse(raw: bytes):
    if len(raw) > MAX_BYTES or raw[:3] == b"\xef\xbb\xbf":
        raise Rejected("document: size or byte order mark")
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        raise Rejected("document: not UTF-8") from None
    depth = most = 0
    quoted = escaped = False
    for ch in text:
        if quoted:
            quoted = escaped or ch != '"'
            escaped = ch == "\\" and not escaped
        elif ch == '"':
            quoted = True
        elif ch in "[{":
            depth += 1
            most = max(most, depth)
        elif ch in "]}":
            depth -= 1
    if most > MAX_DEPTH:
        raise Rejected("document: depth")

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise Rejected("document: a member twice")
        return out

    def constant(name):
        raise Rejected(f"document: {name}")

    try:
        return json.loads(text, object_pairs_hook=unique, parse_constant=constant)
    except (json.JSONDecodeError, RecursionError) as e:
        raise Rejected(f"document: {e}") from None


def integer(v, lo: int, hi: int, what: str) -> int:
    """A JSON number that is a whole number in bounds, however it is written."""
    if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v or v in (float("inf"), -float("inf")) or int(v) != v or not lo <= v <= hi or abs(v) > 2**53 - 1:
        raise Rejected(f"{what}: {v!r}")
    return int(v)


def integers(v, lo: int, hi: int, what: str) -> list[int]:
    if not isinstance(v, list):
        raise Rejected(f"{what}: no list")
    return [integer(x, lo, hi, what) for x in v]
