"""Value types by name, and which may meet in an expression."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names of value types. Whole numbers are 64-bit and floating ones double.
NAMES: dict[str, T.DataType] = {
    "null": T.NullType(),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "int": T.LongType(),
    "int64": T.LongType(),
    "float": T.DoubleType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "symbol": T.StringType(),
    "binary": T.BinaryType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "vector": T.ArrayType(T.FloatType()),
}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a type name; array<x> and map<x> nest, map keys are strings."""
    n = name.strip().lower()
    if n.startswith("array<") and n.endswith(">"):
        return T.ArrayType(spark_type(n[6:-1]))
    if n.startswith("map<") and n.endswith(">"):
        return T.MapType(T.StringType(), spark_type(n[4:-1]))
    if n not in NAMES:
        raise ValueError(f"no type named {name!r}")
    return NAMES[n]


def type_name(t: T.DataType) -> str:
    """The name of a Spark type."""
    if isinstance(t, T.ArrayType):
        return f"array<{type_name(t.elementType)}>"
    if isinstance(t, T.MapType):
        return f"map<{type_name(t.valueType)}>"
    groups = {"int": T.IntegralType, "float": T.FractionalType, "timestamp": (T.TimestampType, T.TimestampNTZType), "string": T.StringType, "bool": T.BooleanType, "date": T.DateType, "binary": T.BinaryType, "null": T.NullType}
    return next((n for n, k in groups.items() if isinstance(t, k)), t.simpleString())


def comparable(a: T.DataType | None, b: T.DataType | None) -> bool:
    """Whether two values may be compared or combined: numbers with numbers, and else like with like.

    A string is never taken for a number or the other way round, though Spark would; null meets anything.
    """
    if a is None or b is None or isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return True
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return True
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return True
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return comparable(a.elementType, b.elementType)
    return type(a) is type(b) or isinstance(a, T.StringType) and isinstance(b, T.StringType)
