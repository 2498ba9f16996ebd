"""Pairs of rows that have values in common, dealt out by the number of pairs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import lift
from ..frames import Frame
from ..functions import col
from ..sources.scratch import stash

#: Rows of a group that meet in one block, from each side; and pairs that a task makes, about.
BLOCK, TASK = 4096, 8_000_000


def meet(frame: Frame, other: Frame, on: list[tuple]) -> Frame:
    """Rows of frame with those rows of other that are equal to them in all pairs of expressions; nulls equal nothing.

    Few rows may make many pairs, so neither the size of the inputs nor that of their files tells how much work there
    is. Groups are counted first, for which both sides are read once more. A group is cut into blocks of BLOCK rows of either side, by the ids of its
    rows; each row goes to the blocks that it takes part in, and blocks are dealt out to as many tasks as the pairs ask for. A
    task holds the rows of one block of other at a time.
    """
    taken = {s.physical for s in frame.slots} & {s.physical for s in other.slots}
    if taken:
        raise ValueError(f"meet: both sides have {sorted(taken)}; give an alias")
    a = [(lift(col(x) if isinstance(x, str) else x)).build(frame.scope) for x, _ in on]
    b = [(lift(col(y) if isinstance(y, str) else y)).build(other.scope) for _, y in on]
    keys = [f"__k{i}" for i in range(len(on))]
    same = [_comparable(frame.data, x, other.data, y) for x, y in zip(a, b, strict=True)]
    left, right = (_keyed(f.data, [s[i] for s in same], keys) for i, f in enumerate((frame, other)))
    sizes = [side.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for side, n in ((left, "__n"), (right, "__m"))]
    groups = stash(sizes[0].join(sizes[1], keys), "groups")
    total = groups.agg(F.sum(F.col("__n").cast("double") * F.col("__m"))).first()[0] or 0
    tasks = max(1, min(100_000, int(total / TASK) + 1))
    cuts = groups.select(*keys, *[F.ceil(F.col(n) / BLOCK).cast("int").alias(c) for n, c in (("__n", "__a"), ("__m", "__b"))])
    parts = []
    for f, side, mine, theirs in ((frame, left, "__a", "__b"), (other, right, "__b", "__a")):
        place = F.pmod(F.xxhash64(*_ids(f)), F.col(mine)).cast("int")
        rows = side.join(cuts, keys).withColumn(mine, place).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)))
        parts.append(rows.repartition(tasks, *keys, "__a", "__b").select(*keys, "__a", "__b", *[F.col(f"`{s.physical}`") for s in f.slots]))
    slots = (*frame.slots, *other.slots)
    # Bounded in memory whatever the plan takes the sides' sizes to be.
    data = parts[0].join(parts[1].hint("merge"), [*keys, "__a", "__b"]).select(*[F.col(f"`{s.physical}`") for s in slots])
    named = ", ".join(f"{x!r} = {y!r}" for x, y in on)
    return replace(frame, data=data, slots=slots, kinds=frame.kinds | other.kinds, labels=frame.labels | other.labels, current=other.current, plan=(*frame.plan, f"Meet({named})"))


def _comparable(left: DataFrame, a: Column, right: DataFrame, b: Column) -> tuple[Column, Column]:
    """Both as one type, of which equal values are the same when hashed."""
    kinds = [df.select(c).schema[0].dataType for df, c in ((left, a), (right, b))]
    if all(isinstance(k, T.NumericType) for k in kinds) and any(isinstance(k, T.FractionalType) and not isinstance(k, T.DecimalType) for k in kinds):
        return tuple((c.cast("double") + F.lit(0.0)).cast("string") for c in (a, b))  # one zero, one NaN
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return a.cast("long"), b.cast("long")
    if kinds[0] != kinds[1]:
        raise TypeError(f"meet: {kinds[0].simpleString()} and {kinds[1].simpleString()} are not compared")
    return a, b


def _keyed(data: DataFrame, values: list[Column], keys: list[str]) -> DataFrame:
    return data.withColumns(dict(zip(keys, values, strict=True))).dropna(subset=keys)


def _ids(f: Frame) -> list[Column]:
    """The columns that tell rows apart: ids of its nodes and edges, or all that can be hashed."""
    ids = [s.physical for s in f.slots if s.name == "_id"]
    return [F.col(f"`{c}`") for c in ids or [x.name for x in f.data.schema if "map<" not in x.dataType.simpleString()]]
