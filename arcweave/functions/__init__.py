"""Functions of expressions, and aggregates."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import AggExpr, Expr, binary, call, checked, col, lift, lit, param, prop
from ..scope import FieldScope
from ..types import type_name

# --- strings


def concat(*parts: Any) -> Expr:
    """Null if any part is null."""
    return call("CONCAT", F.concat, *parts)


def length(e: Any) -> Expr:
    return lift(e).length()


size = array_length = length


def lower(e: Any) -> Expr:
    return lift(e).lower()


def upper(e: Any) -> Expr:
    return lift(e).upper()


def trim(e: Any) -> Expr:
    return lift(e).trim()


def ltrim(e: Any) -> Expr:
    return lift(e).ltrim()


def rtrim(e: Any) -> Expr:
    return lift(e).rtrim()


def contains(e: Any, part: Any) -> Expr:
    return lift(e).contains(part)


def substring(e: Any, start: int, length: int | None = None) -> Expr:
    return lift(e).substring(start, length)


def replace(e: Any, old: Any, new: Any) -> Expr:
    return lift(e).replace(old, new)


def split(e: Any, delimiter: str) -> Expr:
    return lift(e).split(delimiter)


def left(e: Any, n: Any) -> Expr:
    return call("LEFT", F.left, e, n)


def right(e: Any, n: Any) -> Expr:
    return call("RIGHT", F.right, e, n)


def reverse(e: Any) -> Expr:
    return call("REVERSE", F.reverse, e)


def to_string(e: Any) -> Expr:
    return lift(e).cast("string")


# --- numbers


def abs_(e: Any) -> Expr:
    return call("ABS", F.abs, e)


def ceil(e: Any) -> Expr:
    return call("CEIL", F.ceil, e)


def floor(e: Any) -> Expr:
    return call("FLOOR", F.floor, e)


def round_(e: Any, decimals: int = 0) -> Expr:
    """Halves go away from zero."""
    return call("ROUND", lambda x: F.round(x, decimals), e)


def sqrt(e: Any) -> Expr:
    return call("SQRT", F.sqrt, e)


def power(base: Any, exponent: Any) -> Expr:
    return call("POW", F.pow, base, exponent)


def ln(e: Any) -> Expr:
    return call("LN", F.ln, e)


log = ln


def log10(e: Any) -> Expr:
    return call("LOG10", F.log10, e)


def exp(e: Any) -> Expr:
    return call("EXP", F.exp, e)


def sign(e: Any) -> Expr:
    return call("SIGN", F.signum, e)


# --- nulls, conditions, types


def coalesce(*parts: Any) -> Expr:
    return checked("COALESCE", F.coalesce, *parts)


def nullif(a: Any, b: Any) -> Expr:
    return lift(a).nullif(b)


def ifnull(a: Any, b: Any) -> Expr:
    return checked("IFNULL", F.coalesce, a, b)


def if_(condition: Any, then: Any, else_: Any) -> Expr:
    return call("IF", lambda c, a, b: F.when(c, a).otherwise(b), condition, then, else_)


class When(Expr):
    """Chained conditions: when(c, a).when(d, b).otherwise(x)."""

    def when(self, condition: Any, value: Any) -> When:
        return _case((*self.payload[0], (lift(condition), lift(value))), self.payload[1])

    def otherwise(self, value: Any) -> When:
        return _case(self.payload[0], lift(value))


def _case(arms: tuple, other: Expr | None) -> When:
    def build(s):
        out = F
        for c, v in arms:
            out = out.when(c.build(s), v.build(s))
        return out.otherwise(other.build(s)) if other is not None else out

    parts = tuple(x for arm in arms for x in arm) + ((other,) if other is not None else ())
    return When("CASE", build, parts, payload=(arms, other))


_NONE = object()


def when(condition: Any, then: Any, else_: Any = _NONE) -> When:
    """A condition, to be chained; without a fitting arm the value is null."""
    return _case(((lift(condition), lift(then)),), None if else_ is _NONE else lift(else_))


def case(subject: Any, arms: list[tuple[Any, Any]], else_: Any = None) -> Expr:
    """The value of the first arm whose key equals the subject."""
    return _case(tuple((binary("=", subject, k), lift(v)) for k, v in arms), lift(else_))


def cast(e: Any, name: str) -> Expr:
    return lift(e).cast(name)


def try_cast(e: Any, name: str) -> Expr:
    return lift(e).try_cast(name)


def typeof(e: Any) -> Expr:
    e = lift(e)
    return Expr("TYPEOF", lambda s: F.lit(type_name(s.type_of(e.build(s)))), (e,))


# --- dates and times


def date(e: Any) -> Expr:
    return call("DATE", F.to_date, e)


def timestamp(e: Any) -> Expr:
    return call("TIMESTAMP", lambda x: x.cast(T.TimestampNTZType()), e)


def year(e: Any) -> Expr:
    return call("YEAR", F.year, e)


def month(e: Any) -> Expr:
    return call("MONTH", F.month, e)


def day(e: Any) -> Expr:
    return call("DAY", F.dayofmonth, e)


def hour(e: Any) -> Expr:
    return call("HOUR", F.hour, e)


def minute(e: Any) -> Expr:
    return call("MINUTE", F.minute, e)


def second(e: Any) -> Expr:
    return call("SECOND", F.second, e)


def current_date() -> Expr:
    return call("CURRENT_DATE", F.current_date)


def current_timestamp() -> Expr:
    return call("CURRENT_TIMESTAMP", F.localtimestamp)


def date_part(unit: str, e: Any) -> Expr:
    return call("DATE_PART", lambda x: F.date_part(F.lit(unit), x), e)


def date_trunc(unit: str, e: Any) -> Expr:
    return call("DATE_TRUNC", lambda x: F.date_trunc(unit, x), e)


def date_add(e: Any, n: Any, unit: str = "day") -> Expr:
    return call("DATE_ADD", lambda x, k: F.timestamp_add(unit, k.cast("int"), x) if unit != "day" else F.date_add(F.to_date(x), k.cast("int")), e, n)


def date_diff(end: Any, start: Any, unit: str = "day") -> Expr:
    """Whole units from start to end."""
    return call("DATE_DIFF", lambda a, b: F.datediff(a, b) if unit == "day" else F.timestamp_diff(unit, b, a), end, start)


# --- vectors; sums in double


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in dimension")))


def inner_product(a: Any, b: Any) -> Expr:
    return call("INNER_PRODUCT", lambda x, y: _same(x, y, _dot(x, y)), a, b)


def sim(a: Any, b: Any) -> Expr:
    """Cosine similarity; null if either is zero."""
    return call("COSINE_SIMILARITY", lambda x, y: _same(x, y, _dot(x, y) / F.nullif(F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y)), F.lit(0.0))), a, b)


cosine_similarity = sim


def distance(a: Any, b: Any) -> Expr:
    """Euclidean distance."""
    def f(x, y):
        return F.sqrt(_fold(F.zip_with(x, y, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))))

    return call("EUCLIDEAN_DISTANCE", lambda x, y: _same(x, y, f(x, y)), a, b)


euclidean_distance = distance


def l2_norm(a: Any) -> Expr:
    return call("L2_NORM", lambda x: F.sqrt(_dot(x, x)), a)


def vector_dim(a: Any) -> Expr:
    return call("VECTOR_DIM", lambda x: F.size(x).cast("long"), a)


# --- collections


def array(*parts: Any) -> Expr:
    return call("ARRAY", F.array, *parts)


def array_contains(e: Any, x: Any) -> Expr:
    return lift(e).contains_element(x)


def keys(e: Any) -> Expr:
    return lift(e).keys()


def values(e: Any) -> Expr:
    return lift(e).values()


def get_json(e: Any, path: str) -> Expr:
    return call("GET_JSON", lambda x: F.get_json_object(x, path), e)


# --- entities and paths


def _member(e: Any, name: str, what: str) -> Expr:
    e = lift(e)
    return Expr(what, lambda s: s.column(f"{e.name}.{name}") if e.kind == "column" else e.build(s)[name], (e,))


def id_(e: Any) -> Expr:
    return _member(e, "_id", "ID")


def labels(e: Any) -> Expr:
    return _member(e, "_labels", "LABELS")


def type_(e: Any) -> Expr:
    return _member(e, "_type", "TYPE")


def properties(e: Any) -> Expr:
    """An entity's properties as a map of strings, without those that are null."""
    e = lift(e)

    def build(s):
        mine = [m for m in s.members(e.name) if not m.name.startswith("_")]
        pairs = F.array(*[F.struct(F.lit(m.name).alias("k"), F.col(f"`{m.physical}`").cast("string").alias("v")) for m in mine])
        return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))

    return Expr("PROPERTIES", build, (e,))


def nodes(path: Any) -> Expr:
    return call("NODES", lambda p: p["nodes"], path)


def relationships(path: Any) -> Expr:
    return call("RELATIONSHIPS", lambda p: p["edges"], path)


def path_length(path: Any) -> Expr:
    return call("PATH_LENGTH", lambda p: F.size(p["edges"]), path)


def start_node(e: Any) -> Expr:
    """Id of an edge's source, or of a path's first node."""
    e = lift(e)
    return Expr("START_NODE", lambda s: _end(s, e, "_src", 1), (e,))


def end_node(e: Any) -> Expr:
    """Id of an edge's target, or of a path's last node."""
    e = lift(e)
    return Expr("END_NODE", lambda s: _end(s, e, "_dst", -1), (e,))


def _end(s, e: Expr, name: str, at: int) -> Column:
    if s.kinds.get(e.name) == "edge":
        return s.column(f"{e.name}.{name}")
    return F.element_at(e.build(s)["nodes"], at)["_id"]


def _over(name: str, f, e: Any, predicate: Expr | None) -> Expr:
    e = lift(e)
    test = (lambda x: x) if predicate is None else (lambda x: predicate.build(FieldScope(x)))
    return Expr(name, lambda s: f(e.build(s), test), (e,))


def any_(e: Any, predicate: Expr | None = None) -> Expr:
    """Whether the predicate, on the fields of an element, is true for any element."""
    return _over("ANY", F.exists, e, predicate)


def all_(e: Any, predicate: Expr | None = None) -> Expr:
    return _over("ALL", F.forall, e, predicate)


def none_(e: Any, predicate: Expr | None = None) -> Expr:
    return ~_over("ANY", F.exists, e, predicate)


# --- subqueries


def exists(frame: Any, on: tuple[str, str] | None = None) -> Expr:
    """Whether a frame has a row for the outer row: one whose start is the outer node, if both are of one
    label, else one with on=(outer column, inner column) equal. ~exists() is the opposite."""
    def fail(s):
        raise ValueError("exists() stands in filter, alone or with & | ~")

    return Expr("EXISTS", fail, kind="exists", payload=(frame, on))


def scalar(frame: Any) -> Expr:
    """The value of a frame of one column and at most one row; null without a row."""
    return Expr("SCALAR", lambda s: frame.data.scalar())


# --- aggregates


def _agg(name: str, f, e: Any, *more: Any) -> AggExpr:
    e = lift(e) if not isinstance(e, str) else col(e)
    rest = [lift(m) for m in more]
    return AggExpr(f"{name}({e!r})", lambda s: f(e.build(s), *[m.build(s) for m in rest]))


def count(e: Any = None) -> AggExpr:
    """Rows, or values that aren't null."""
    return AggExpr("COUNT(*)", lambda s: F.count(F.lit(1))) if e is None else _agg("COUNT", F.count, e)


def count_distinct(e: Any) -> AggExpr:
    return _agg("COUNT_DISTINCT", F.count_distinct, e)



def sum_(e: Any, distinct: bool = False) -> AggExpr:
    """Whole numbers sum to a whole number, and overflow raises; null without values."""
    return _agg("SUM", F.sum_distinct if distinct else F.sum, e)


def avg(e: Any, distinct: bool = False) -> AggExpr:
    return _agg("AVG", (lambda x: F.sum_distinct(x.cast("double")) / F.count_distinct(x)) if distinct else (lambda x: F.avg(x.cast("double"))), e)


def min_(e: Any) -> AggExpr:
    return _agg("MIN", F.min, e)


def max_(e: Any) -> AggExpr:
    return _agg("MAX", F.max, e)


def collect(e: Any, distinct: bool = False) -> AggExpr:
    """Values that aren't null, in order, so that the result doesn't depend on the order of rows."""
    return _agg("COLLECT", lambda x: F.array_sort(F.collect_set(x) if distinct else F.collect_list(x)), e)


array_agg = collect


def collect_distinct(e: Any) -> AggExpr:
    return _agg("COLLECT_DISTINCT", lambda x: F.array_sort(F.collect_set(x)), e)


def first(e: Any, by: Any = None) -> AggExpr:
    """The value in the row that is first by `by`; without it, the smallest value, which is the same whatever the order of rows."""
    return _agg("FIRST", F.min, e) if by is None else _agg("FIRST", F.min_by, e, by if isinstance(by, Expr) else col(by))


def last(e: Any, by: Any = None) -> AggExpr:
    """As first, from the end: without `by`, the largest value."""
    return _agg("LAST", F.max, e) if by is None else _agg("LAST", F.max_by, e, by if isinstance(by, Expr) else col(by))


def stddev(e: Any) -> AggExpr:
    return _agg("STDDEV", F.stddev, e)


def stddev_pop(e: Any) -> AggExpr:
    return _agg("STDDEV_POP", F.stddev_pop, e)


def variance(e: Any) -> AggExpr:
    return _agg("VARIANCE", F.variance, e)


def variance_pop(e: Any) -> AggExpr:
    return _agg("VARIANCE_POP", F.var_pop, e)


def percentile(e: Any, share: float) -> AggExpr:
    """Exact, interpolated."""
    return _agg("PERCENTILE", lambda x: F.percentile(x, F.lit(share)), e)


def median(e: Any) -> AggExpr:
    return _agg("MEDIAN", F.median, e)


def mode(e: Any) -> AggExpr:
    """The most frequent value, of several the smallest."""
    return _agg("MODE", lambda x: F.mode(x, deterministic=True), e)


def string_agg(e: Any, delimiter: str = ",") -> AggExpr:
    """Values in order, joined."""
    return _agg("STRING_AGG", lambda x: F.array_join(F.array_sort(F.collect_list(x)), delimiter), e)


def approx_count_distinct(e: Any) -> AggExpr:
    return _agg("APPROX_COUNT_DISTINCT", F.approx_count_distinct, e)


def udf(name: str, *args: Any) -> Expr:
    """A function registered by register_udf."""
    if name not in REGISTRY:
        raise KeyError(f"no function registered as {name!r}")
    return call(name, REGISTRY[name], *args)


#: Functions by name: Spark column functions, pandas_udf results or grouped aggregates.
REGISTRY: dict[str, Any] = {}


def register_udf(name: str, f: Any) -> None:
    """Register a function of columns; a pandas_udf runs in Arrow batches."""
    REGISTRY[name] = f


def udaf(name: str, e: Any) -> AggExpr:
    """A registered grouped aggregate, such as a pandas_udf of a Series to a scalar."""
    return _agg(name, REGISTRY[name], e)


__all__ = [n for n, v in list(globals().items()) if not n.startswith("_") and n not in ("annotations", "Any", "Column", "F", "T")]
__all__ += ["col", "lit", "param", "prop"]
_ = (col, lit, param, prop)
