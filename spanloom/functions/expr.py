"""The rule language, compiled to Columns.

Values may be absent (null).  A comparison with an absent operand is false, arithmetic with one is absent,
``!absent`` is true, and division is that of IEEE 754.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|('(?:[^'\\]|\\.)*')|([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)|(\?\?|\|\||&&|==|!=|<=|>=|[-+*/<>!?:,()\[\]]))")


class Value:
    """A Column with the kind of its values: num, bool, str, list or any."""

    def __init__(self, col: Column, kind: str):
        self.col, self.kind = col, kind

    def truth(self) -> Column:
        c = self.col
        test = {"num": lambda: (c != 0) & ~F.isnan(c.cast("double")), "bool": lambda: c, "str": lambda: c != "", "list": lambda: F.size(c) > 0}
        return F.coalesce(test.get(self.kind, lambda: c.isNotNull())(), F.lit(False))


def _divide(a: Column, b: Column) -> Column:
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    none = a.isNull() | b.isNull()
    zero = F.when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)
    return F.when(none, F.lit(None).cast("double")).when(b == 0, zero).otherwise(F.try_divide(a, F.when(b != 0, b)))


class Parser:
    """Precedence from low to high: ?:, ??, ||, &&, comparison, + -, * /, unary."""

    def __init__(self, text: str, names: dict[str, Value]):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"expression: {text[at:]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.names, self.at = names, 0

    def peek(self):
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *what):
        if self.peek() in what and self.tokens[self.at][0] == 4:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, what):
        if not self.take(what):
            raise ValueError(f"expression: {what} expected")

    def parse(self) -> Value:
        out = self.choice()
        if self.at != len(self.tokens):
            raise ValueError(f"expression: {self.peek()!r} left over")
        return out

    def choice(self) -> Value:
        c = self.either()
        if self.take("?"):
            a = self.choice()
            self.need(":")
            b = self.choice()
            return Value(F.when(c.truth(), a.col).otherwise(b.col), a.kind)
        return c

    def either(self) -> Value:
        a = self.any_of()
        while self.take("??"):
            a = Value(F.coalesce(a.col, self.any_of().col), a.kind)
        return a

    def any_of(self) -> Value:
        a = self.all_of()
        while self.take("||"):
            a = Value(a.truth() | self.all_of().truth(), "bool")
        return a

    def all_of(self) -> Value:
        a = self.compared()
        while self.take("&&"):
            a = Value(a.truth() & self.compared().truth(), "bool")
        return a

    def compared(self) -> Value:
        a = self.added()
        op = self.take("==", "!=", "<", "<=", ">", ">=")
        if not op:
            return a
        b = self.added()
        x, y = a.col, b.col
        got = {"==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()
        if a.kind == b.kind == "num":  # not a number equals nothing, itself neither
            nan = F.isnan(x.cast("double")) | F.isnan(y.cast("double"))
            got = F.when(nan, F.lit(op == "!=")).otherwise(got)
        return Value(F.coalesce(got & x.isNotNull() & y.isNotNull(), F.lit(False)), "bool")

    def added(self) -> Value:
        a = self.multiplied()
        while op := self.take("+", "-"):
            b = self.multiplied()
            a = Value(a.col + b.col if op == "+" else a.col - b.col, "num")
        return a

    def multiplied(self) -> Value:
        a = self.unary()
        while op := self.take("*", "/"):
            b = self.unary()
            a = Value(a.col * b.col if op == "*" else _divide(a.col, b.col), "num")
        return a

    def unary(self) -> Value:
        if self.take("!"):
            return Value(~self.unary().truth(), "bool")
        if self.take("-"):
            return Value(-self.unary().col, "num")
        return self.atom()

    def items(self, end: str) -> list[Value]:
        out = []
        while not self.take(end):
            if out:
                self.need(",")
            out.append(self.choice())
        return out

    def atom(self) -> Value:
        if self.at >= len(self.tokens):
            raise ValueError("expression: ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return Value(F.lit(float(text)), "num")
        if kind == 2:
            return Value(F.lit(re.sub(r"\\(.)", r"\1", text[1:-1])), "str")
        if kind == 3:
            if text in ("true", "false"):
                return Value(F.lit(text == "true"), "bool")
            if self.take("("):
                return self.call(text, self.items(")"))
            if text not in self.names:
                raise ValueError(f"expression: {text} is unknown")
            return self.names[text]
        if text == "(":
            out = self.choice()
            self.need(")")
            return out
        if text == "[":
            return Value(F.array(*(v.col for v in self.items("]"))), "list")
        raise ValueError(f"expression: {text!r}")

    def call(self, name: str, args: list[Value]) -> Value:
        c = args[0].col if args else None
        is_list = bool(args) and args[0].kind == "list"
        if name == "present":
            return Value(c.isNotNull(), "bool")
        if name == "abs":
            return Value(F.abs(c), "num")
        if name == "finite":
            fine = ~F.isnan(c) & (F.abs(c) < float("inf")) if args[0].kind == "num" else F.lit(True)
            return Value(F.coalesce(fine, F.lit(True)), "bool")
        if name == "len":
            return Value((F.coalesce(F.size(c), F.lit(0)) if is_list else c.isNotNull()).cast("double"), "num")
        if name == "sum":
            total = F.aggregate(F.filter(c, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x) if is_list else c
            return Value(total, "num")
        if name == "distinct":
            return Value(F.size(F.array_distinct(c)).cast("double"), "num")
        if name == "same":
            return Value(F.when(F.size(F.array_distinct(c)) == 1, F.get(c, F.lit(0))).otherwise(0), "num")
        if name == "first":
            return Value(F.get(c, F.lit(0)) if is_list else c, "num")
        if name == "at":
            return Value(F.get(c, args[1].col.cast("int")), "num")
        if name in ("min", "max"):
            values = c if is_list else F.array(*(a.col for a in args))
            return Value(F.array_min(values) if name == "min" else F.array_max(values), "num")
        if name == "in":
            return Value(F.coalesce(F.array_contains(args[1].col, c), F.lit(False)), "bool")
        if name == "int":
            lo, hi = args[1].col, args[2].col
            whole = lambda x: (x == F.floor(x)) & (F.abs(x) <= float(2**53 - 1)) & (x >= lo) & (x <= hi)
            return Value(F.coalesce(F.forall(c, whole) if is_list else whole(c), F.lit(False)), "bool")
        if name == "kind":
            return Value(F.when(c.isNull(), "absent").otherwise({"num": "number", "bool": "bool", "str": "string", "list": "list"}[args[0].kind]), "str")
        raise ValueError(f"expression: {name}()")


def names_of(df: DataFrame) -> dict[str, Value]:
    """The columns of a DataFrame as names; integers become binary64."""
    out = {}
    for name, kind in df.dtypes:
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            out[name] = Value(F.col(name).cast("double"), "num")
        elif kind in ("string", "boolean"):
            out[name] = Value(F.col(name), "str" if kind == "string" else "bool")
        elif kind.startswith("array"):
            item = kind[6:-1]
            out[name] = Value(F.col(name).cast("array<double>") if item in ("int", "bigint", "double", "float") else F.col(name), "list")
    return out


def compile_(text: str, df: DataFrame, more: dict[str, Value] | None = None) -> Value:
    return Parser(text, names_of(df) | (more or {})).parse()


def reject(df: DataFrame, derive: list[tuple[str, str]], constraints: list[tuple[str, str]]) -> Column:
    """The message of the first constraint that fails, null if none does; ``{name}`` in it is a value.

    derive: (name, expression) in order; constraints: (expression, message).
    """
    names: dict[str, Value] = {}
    for name, text in derive:
        names[name] = compile_(text, df, names)
    out = None
    for text, message in constraints:
        failed = ~compile_(text, df, names).truth()
        told = [F.lit(p) if k % 2 == 0 else shown((names_of(df) | names)[p]) for k, p in enumerate(re.split(r"\{([A-Za-z0-9_.]+)\}", message))]
        out = F.when(failed, F.concat(*told)) if out is None else out.when(failed, F.concat(*told))
    return out


def shown(v: Value) -> Column:
    """A value in a message: whole numbers without a fraction, ``none`` if absent."""
    text = F.when(v.col == F.floor(v.col), v.col.cast("bigint").cast("string")).otherwise(v.col.cast("string")) if v.kind == "num" else v.col.cast("string")
    return F.coalesce(text, F.lit("none"))
