"""Expressions: what a frame's methods take; they become Spark columns when a frame resolves them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import comparable, spark_type


@dataclass(frozen=True, eq=False)
class Expr:
    """An expression without a frame. name: of its output; build: makes its column in a scope."""

    name: str
    build: Callable[[Any], Column]
    parts: tuple[Expr, ...] = ()
    kind: str = "fn"
    payload: Any = None
    descending: bool | None = None
    nulls: str | None = None

    __hash__ = object.__hash__

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use & | ~")

    def alias(self, name: str) -> Expr:
        return replace(self, name=name, kind="alias" if self.kind == "column" else self.kind)

    as_ = alias

    # comparison and arithmetic
    def __eq__(self, other):  # type: ignore[override]
        return binary("=", self, other)

    def __ne__(self, other):  # type: ignore[override]
        return binary("<>", self, other)

    def __lt__(self, other):
        return binary("<", self, other)

    def __le__(self, other):
        return binary("<=", self, other)

    def __gt__(self, other):
        return binary(">", self, other)

    def __ge__(self, other):
        return binary(">=", self, other)

    def __add__(self, other):
        return binary("+", self, other)

    def __radd__(self, other):
        return binary("+", other, self)

    def __sub__(self, other):
        return binary("-", self, other)

    def __rsub__(self, other):
        return binary("-", other, self)

    def __mul__(self, other):
        return binary("*", self, other)

    def __rmul__(self, other):
        return binary("*", other, self)

    def __truediv__(self, other):
        return binary("/", self, other)

    def __rtruediv__(self, other):
        return binary("/", other, self)

    def __mod__(self, other):
        return binary("%", self, other)

    def __rmod__(self, other):
        return binary("%", other, self)

    def __neg__(self):
        return call("NEG", lambda x: -x, self)

    def __and__(self, other):
        return binary("AND", self, other)

    def __rand__(self, other):
        return binary("AND", other, self)

    def __or__(self, other):
        return binary("OR", self, other)

    def __ror__(self, other):
        return binary("OR", other, self)

    def __invert__(self):
        if self.kind in ("exists", "not exists"):
            return replace(self, kind="exists" if self.kind == "not exists" else "not exists")
        return call("NOT", lambda x: ~x, self)

    def is_distinct_from(self, other):
        return call("IS DISTINCT FROM", lambda a, b: ~a.eqNullSafe(b), self, other)

    def is_not_distinct_from(self, other):
        return call("IS NOT DISTINCT FROM", lambda a, b: a.eqNullSafe(b), self, other)

    def is_true(self):
        return call("IS TRUE", lambda x: x.eqNullSafe(F.lit(True)), self)

    def is_false(self):
        return call("IS FALSE", lambda x: x.eqNullSafe(F.lit(False)), self)

    def is_unknown(self):
        return call("IS UNKNOWN", lambda x: x.isNull(), self)

    def is_in(self, values):
        """Null in the list makes a miss unknown, as in SQL."""
        return checked("IN", lambda x, *v: x.isin(*v) if v else F.lit(False), self, *values)

    def not_in(self, values):
        return ~self.is_in(values)

    def between(self, low, high):
        return checked("BETWEEN", lambda x, a, b: x.between(a, b), self, low, high)

    def not_between(self, low, high):
        return ~self.between(low, high)

    # nulls
    def is_null(self):
        return call("IS NULL", lambda x: x.isNull(), self)

    def is_not_null(self):
        return call("IS NOT NULL", lambda x: x.isNotNull(), self)

    def coalesce(self, *values):
        return checked("COALESCE", F.coalesce, self, *values)

    def fill_null(self, value):
        return checked("IFNULL", F.coalesce, self, value)

    def nullif(self, other):
        return checked("NULLIF", F.nullif, self, other)

    # strings
    def contains(self, part, case_sensitive: bool = True):
        if not case_sensitive:
            return call("CONTAINS", lambda x, y: F.lower(x).contains(F.lower(y)), self, part)
        return call("CONTAINS", lambda x, y: x.contains(y), self, part)

    def starts_with(self, part):
        return call("STARTS_WITH", lambda x, y: x.startswith(y), self, part)

    def ends_with(self, part):
        return call("ENDS_WITH", lambda x, y: x.endswith(y), self, part)

    def matches(self, pattern: str):
        """Whether the whole string matches the pattern."""
        return call("REGEX_MATCH", lambda x: x.rlike(f"^(?:{pattern})$"), self)

    def like(self, pattern: str):
        return call("LIKE", lambda x: x.like(pattern), self)

    def lower(self):
        return call("LOWER", F.lower, self)

    def upper(self):
        return call("UPPER", F.upper, self)

    def trim(self):
        return call("TRIM", F.trim, self)

    def ltrim(self):
        return call("LTRIM", F.ltrim, self)

    def rtrim(self):
        return call("RTRIM", F.rtrim, self)

    def replace(self, old, new):
        return call("REPLACE", F.replace, self, old, new)

    def substring(self, start: int, length: int | None = None):
        """From the start-th character on, counted from 1."""
        if length is None:
            return call("SUBSTRING", lambda x: F.substr(x, F.lit(start)), self)
        return call("SUBSTRING", lambda x: F.substring(x, start, length), self)

    def split(self, delimiter: str):
        """Parts between the delimiter, which is text and not a pattern."""
        quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return call("SPLIT", lambda x: F.split(x, quoted), self)

    def concat(self, *others):
        return call("CONCAT", F.concat, self, *others)

    # collections
    def length(self):
        """Characters of a string, elements of an array or a map."""
        return Expr("LENGTH", lambda s: _length(s, self), (self,))

    size = length

    def get(self, key):
        """An array's element, counted from 0, or a map's value; null where there is none."""
        key = lift(key)

        def build(s):
            c = self.build(s)
            return F.try_element_at(c, key.build(s)) if isinstance(s.type_of(c), T.MapType) else F.get(c, key.build(s).cast("int"))

        return Expr("GET", build, (self, key))

    def contains_element(self, element):
        """Whether an array holds a value; of a single value and a list, whether the list holds the value."""
        if isinstance(element, (list, tuple)):
            return self.is_in(element)
        return call("ARRAY_CONTAINS", F.array_contains, self, element)

    def keys(self):
        return call("MAP_KEYS", F.map_keys, self)

    def values(self):
        return call("MAP_VALUES", F.map_values, self)

    def explode(self):
        return call("EXPLODE", F.explode, self)

    def properties(self):
        from .functions import properties

        return properties(self)

    # types and order
    def cast(self, name: str):
        return call("CAST", lambda x: x.cast(spark_type(name)), self)

    def try_cast(self, name: str):
        return call("TRY_CAST", lambda x: x.try_cast(spark_type(name)), self)

    def asc(self):
        return replace(self, descending=False)

    def desc(self):
        return replace(self, descending=True)

    def nulls_first(self):
        return replace(self, nulls="first")

    def nulls_last(self):
        return replace(self, nulls="last")

    def __repr__(self) -> str:
        inner = ", ".join(map(repr, self.parts))
        return self.name if not self.parts or self.kind in ("column", "alias") else f"{self.name}({inner})"


def _length(s, e: Expr) -> Column:
    c = e.build(s)
    n = F.size(c) if isinstance(s.type_of(c), (T.ArrayType, T.MapType)) else F.length(c)
    return n.cast("long")


def col(name: str) -> Expr:
    """A column `name` or `alias.name`, a whole entity by its alias, or all columns: `*`, `alias.*`."""
    if name == "*" or name.endswith(".*"):
        def fail(s):
            raise ValueError("a wildcard stands alone in select")

        return Expr(name, fail, kind="wildcard")
    return Expr(name, lambda s: s.column(name), kind="column")


prop = col


def lit(value: Any) -> Expr:
    """A literal: None, bool, int, float, str, bytes, date, datetime or a list or str-keyed dict of those."""
    def build(_):
        if isinstance(value, (list, tuple)):
            return F.array(*[lit(v).build(None) for v in value])
        if isinstance(value, dict):
            return F.create_map(*[x for k, v in value.items() for x in (F.lit(k), lit(v).build(None))])
        return F.lit(value)

    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys of a map are strings")
    elif value is not None and not isinstance(value, (bool, int, float, str, bytes, date, datetime, list, tuple)):
        raise TypeError(f"no literal of {type(value).__name__}")
    return Expr(repr(value), build, kind="literal", payload=value)


def param(name: str) -> Expr:
    """A placeholder; Frame.bind, before the method that uses it, gives it a value."""
    def build(s):
        bound = getattr(s, "params", None) or {}
        if name not in bound:
            raise ValueError(f"no value for parameter {name!r}; bound: {sorted(bound)}")
        return lit(bound[name]).build(s)

    return Expr(f"${name}", build, kind="param", payload=name)


def lift(x: Any) -> Expr:
    return x if isinstance(x, Expr) else lit(x)


def call(name: str, f: Callable[..., Column], *args: Any) -> Expr:
    parts = tuple(map(lift, args))
    return Expr(name, lambda s: f(*[p.build(s) for p in parts]), parts)


def checked(name: str, f: Callable[..., Column], *args: Any) -> Expr:
    """As call, when all arguments must be comparable with the first."""
    parts = tuple(map(lift, args))

    def build(s):
        cols = [p.build(s) for p in parts]
        kinds = [s.type_of(c) for c in cols]
        for k in kinds[1:]:
            if not comparable(kinds[0], k):
                raise TypeError(f"{name}: {kinds[0].simpleString()} and {k.simpleString()} don't go together")
        return f(*cols)

    return Expr(name, build, parts)


def _divide(s, a: Column, b: Column, ka, kb) -> Column:
    # Whole numbers divide to a whole number, towards zero.
    return F.call_function("div", a, b) if isinstance(ka, T.IntegralType) and isinstance(kb, T.IntegralType) else a / b


OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "%": lambda a, b: a % b,
    "AND": lambda a, b: a & b,
    "OR": lambda a, b: a | b,
}


def binary(op: str, left: Any, right: Any) -> Expr:
    left, right = lift(left), lift(right)

    def build(s):
        a, b = left.build(s), right.build(s)
        if op in ("AND", "OR"):
            return OPERATORS[op](a, b)
        ka, kb = s.type_of(a), s.type_of(b)
        if not comparable(ka, kb):
            raise TypeError(f"{op}: {ka.simpleString()} and {kb.simpleString()} don't go together")
        if op == "/":
            return _divide(s, a, b, ka, kb)
        return OPERATORS[op](a, b)

    return Expr(op, build, (left, right), kind=op)


def walk(e: Expr):
    yield e
    for p in e.parts:
        yield from walk(p)


def conjuncts(e: Expr) -> list[Expr]:
    return [c for p in e.parts for c in conjuncts(p)] if e.kind == "AND" else [e]


@dataclass(frozen=True, eq=False)
class AggExpr:
    """An aggregate of a group. build: makes its column in a scope."""

    name: str
    build: Callable[[Any], Column]

    def alias(self, name: str) -> AggExpr:
        return replace(self, name=name)

    as_ = alias

    def __repr__(self) -> str:
        return self.name
