"""Frames: lazy, immutable query builders; each method adds to a Spark plan."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .expr import AggExpr, Expr, col, conjuncts, lift, walk
from .functions import count as count_rows
from .graph import Hypergraph
from .scope import Scope, Slot, physical
from .types import type_name

EXPLAIN = ("logical", "optimized", "physical", "cost")


@dataclass(frozen=True)
class FrameSchema:
    """Columns of a frame: output names and types by name."""

    columns: tuple[tuple[str, str], ...]
    entity_type: str
    label: str | None

    def column_names(self) -> list[str]:
        return [c for c, _ in self.columns]

    def column_count(self) -> int:
        return len(self.columns)

    def has_column(self, name: str) -> bool:
        return name in dict(self.columns)

    def column_type(self, name: str) -> str | None:
        return dict(self.columns).get(name)


def fresh(taken: Iterable[str], name: str) -> str:
    """The name, with a number if it's taken."""
    taken = set(taken)
    n = 2
    out = name
    while out in taken:
        out, n = f"{name}_{n}", n + 1
    return out


@dataclass(frozen=True)
class Frame:
    """Rows of a query.

    data: the DataFrame; slots: its columns by alias and name; current: alias of the node that the next expand
    starts from; labels: labels of each alias, where known; root: the alias that the query began with.
    """

    graph: Hypergraph
    data: DataFrame
    slots: tuple[Slot, ...]
    kinds: dict[str, str] = field(default_factory=dict)
    labels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    current: str | None = None
    root: str | None = None
    plan: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    entity = "rows"

    # --- inner

    @property
    def scope(self) -> Scope:
        return Scope(self.data, self.slots, self.kinds, self.params)

    def _then(self, step: str, **changes) -> Frame:
        return replace(self, plan=(*self.plan, step), **changes)

    def _column(self, e: Expr | str) -> Column:
        return (col(e) if isinstance(e, str) else lift(e)).build(self.scope)

    def _inputs(self) -> list[Column]:
        return [F.col(f"`{s.physical}`") for s in self.slots]

    def _take(self, data: DataFrame) -> DataFrame:
        """data with this frame's columns alone."""
        return data.select(*self._inputs())

    def bind(self, **values: Any) -> Frame:
        """Values of parameters, for the methods that follow."""
        return replace(self, params=self.params | values)

    # --- rows

    def filter(self, predicate: Expr) -> Frame:
        """Rows for which the predicate is true. exists() becomes a semi or anti join, or a flag within OR and NOT."""
        out = self
        for part in conjuncts(lift(predicate)):
            if part.kind in ("exists", "not exists"):
                out = out._semi(part)
                continue
            flags = {}
            for e in walk(part):
                if e.kind in ("exists", "not exists"):
                    name = f"__exists_{len(flags)}"
                    out, flags[id(e)] = replace(out, data=out._mark(e, name)), name
            scope = out.scope
            c = _flagged(part, flags).build(scope) if flags else part.build(scope)
            data = out.data.filter(c)
            out = replace(out, data=out._take(data) if flags else data)
        return out._then(f"Filter({predicate!r})")

    where = filter

    def _link(self, e: Expr) -> tuple[DataFrame, Column, Column]:
        """Distinct keys of the inner frame, and the outer and inner key."""
        frame, on = e.payload
        if on is None:
            cur, root = self.current, frame.root
            same = cur and root and set(self.labels.get(cur, ("?",))) & set(frame.labels.get(root, ("!",)))
            if not same:
                raise ValueError("exists() of another label needs on=(outer column, inner column)")
            on = (f"{cur}._id", f"{root}._id")
        inner = frame.data.select(col(on[1]).build(frame.scope).alias("__k")).distinct()
        return inner, col(on[0]).build(self.scope), F.col("__k")

    def _semi(self, e: Expr) -> Frame:
        inner, a, b = self._link(e)
        return replace(self, data=self.data.join(inner, a == b, "left_semi" if e.kind == "exists" else "left_anti"))

    def _mark(self, e: Expr, name: str) -> DataFrame:
        inner, a, b = self._link(e)
        found = F.col("__k").isNotNull() if e.kind == "exists" else F.col("__k").isNull()
        return self.data.join(inner, a == b, "left").withColumn(name, found).drop("__k")

    def select(self, *columns: str | Expr, **aliases: Expr | str) -> Frame:
        """Columns by name or expression, `*` and `alias.*`, and named ones. Names must differ."""
        items: list[tuple[Slot, Column]] = []
        scope = self.scope
        for c in columns:
            e = col(c) if isinstance(c, str) else lift(c)
            if e.kind == "wildcard":
                found = [s for s in (self.slots if e.name == "*" else scope.members(e.name[:-2])) if not s.name.startswith("_bound_")]
                items += [(s, F.col(f"`{s.physical}`")) for s in found]
            elif e.kind == "column" and (slot := scope.find(e.name)) is not None:
                alias, name = (slot.alias, e.name.partition(".")[2]) if slot.alias and "." in e.name else (None, e.name)
                items.append((Slot(alias, name, physical(alias, name)), F.col(f"`{slot.physical}`")))
            else:
                items.append((Slot(None, e.name, physical(None, e.name)), e.build(scope)))
        for name, e in aliases.items():
            items.append((Slot(None, name, physical(None, name)), self._column(e)))
        names = [s.output for s, _ in items]
        if len(set(names)) < len(names):
            raise ValueError(f"select: names differ from one another, these don't: {sorted({n for n in names if names.count(n) > 1})}")
        return self._projected(items, f"Project({', '.join(names)})")

    def _projected(self, items: list[tuple[Slot, Column]], step: str) -> Frame:
        seen: set[str] = set()
        placed = []
        for s, c in items:
            p = fresh(seen, s.physical)
            seen.add(p)
            placed.append((replace(s, physical=p), c.alias(p)))
        left = {s.alias for s, _ in placed if s.alias}
        data = self.data.select(*[c for _, c in placed])
        keep = self.current if any(s.alias == self.current and s.name == "_id" for s, _ in placed) else None
        return self._then(step, data=data, slots=tuple(s for s, _ in placed), kinds={k: v for k, v in self.kinds.items() if k in left}, current=keep)

    def with_column(self, name: str, e: Expr) -> Frame:
        """All columns and one more, which takes the place of a computed one of the same name."""
        slot = Slot(None, name, physical(None, name))
        if any(s.physical == slot.physical and s.alias for s in self.slots):
            slot = replace(slot, physical=fresh({s.physical for s in self.slots}, slot.physical))
        data = self.data.withColumn(slot.physical, self._column(e))
        slots = tuple(s for s in self.slots if (s.alias, s.name) != (None, name))
        return self._then(f"Project(*, {name})", data=data, slots=(*slots, slot))

    def with_columns(self, **exprs: Expr) -> Frame:
        """As with_column for each; all see the columns from before."""
        cols = {n: self._column(e) for n, e in exprs.items()}
        slots = [Slot(None, n, physical(None, n)) for n in cols]
        kept = tuple(s for s in self.slots if (s.alias, s.name) not in {(None, n) for n in cols})
        return self._then(f"Project(*, {', '.join(cols)})", data=self.data.withColumns({s.physical: cols[s.name] for s in slots}), slots=(*kept, *slots))

    def rename(self, names: dict[str, str] | None = None, **more: str) -> Frame:
        """Old name to new name; the new ones are plain."""
        names = (names or {}) | more
        found = {self.scope.find(old): new for old, new in names.items()}
        out = tuple(Slot(None, found[s], s.physical) if s in found else s for s in self.slots)
        if len({s.output for s in out}) < len(out):
            raise ValueError("rename: a new name is taken")
        return self._then(f"Rename({names})", slots=out)

    def drop(self, *columns: str) -> Frame:
        gone = {self.scope.find(c) for c in columns}
        kept = tuple(s for s in self.slots if s not in gone)
        return self._then(f"Drop({', '.join(columns)})", data=self.data.select(*[F.col(f"`{s.physical}`") for s in kept]), slots=kept)

    def explode(self, column: str | Expr, as_: str) -> Frame:
        """A row for each element; the other columns stay. Rows without elements go."""
        data = self.data.select(*self._inputs(), F.explode(self._column(column)).alias(physical(None, as_)))
        return self._then(f"Explode({column!r} AS {as_})", data=data, slots=(*self.slots, Slot(None, as_, physical(None, as_))))

    unwind = explode

    def order_by(self, *keys: str | Expr, ascending: bool | list[bool] | None = None) -> Frame:
        """Sort; nulls come last in either direction unless a key says otherwise."""
        cols = self._order(keys, ascending)
        return self._then(f"Sort({', '.join(map(str, keys))})", data=self.data.orderBy(*cols))

    def _order(self, keys: Iterable[str | Expr], ascending: bool | list[bool] | None) -> list[Column]:
        flags = [ascending] * len(keys) if isinstance(ascending, bool) else [*(ascending or []), *[True] * len(keys)]
        cols = []
        for k, up in zip(keys, flags, strict=False):
            e = col(k) if isinstance(k, str) else k
            c = self._column(e)
            down = (not up) if e.descending is None else e.descending
            first = e.nulls == "first"
            cols.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
        return cols

    sort = order_by

    def limit(self, n: int, offset: int = 0) -> Frame:
        data = self.data.offset(offset).limit(n) if offset else self.data.limit(n)
        return self._then(f"Limit({n}, offset={offset})", data=data)

    def offset(self, n: int) -> Frame:
        return self._then(f"Offset({n})", data=self.data.offset(n))

    skip = offset

    def head(self, n: int = 5) -> Frame:
        return self.limit(n)

    def tail(self, n: int, *keys: str | Expr) -> Frame:
        """The last n rows in the order of the keys, in that order."""
        back = [replace(e, descending=not e.descending, nulls="first" if e.nulls != "first" else "last") for e in (col(k) if isinstance(k, str) else k for k in keys)]
        return self.order_by(*back).limit(n).order_by(*keys)

    def distinct(self) -> Frame:
        return self._then("Distinct", data=self.data.distinct())

    def unique(self, *columns: str) -> Frame:
        """A row for each combination of the columns; which one is left open. All columns: distinct."""
        if not columns:
            return self.distinct()
        return self._then(f"Unique({', '.join(columns)})", data=self.data.dropDuplicates([self.scope.find(c).physical for c in columns]))

    def cross(self, other: Frame) -> Frame:
        """Every row with every row of another frame, whose aliases are others."""
        both = {s.physical for s in self.slots} & {s.physical for s in other.slots}
        if both:
            raise ValueError(f"cross: both sides have {sorted(both)}; give an alias")
        return self._then("Cross", data=self.data.crossJoin(other.data), slots=(*self.slots, *other.slots), kinds=self.kinds | other.kinds, labels=self.labels | other.labels)

    def meet(self, other: Frame, on: list[tuple[str | Expr, str | Expr]]) -> Frame:
        """Every row with the rows of another frame, whose aliases are others, that are equal in each pair of expressions."""
        from .operators.pairs import meet

        return meet(self, other, on)

    def union(self, other: Frame, distinct: bool = False) -> Frame:
        """Rows of both, matched by name. Both have the same columns, of comparable types."""
        data = self.data.unionByName(other._aligned(self))
        return self._then("Union" + " DISTINCT" * distinct, data=data.distinct() if distinct else data)

    def union_all(self, other: Frame) -> Frame:
        return self.union(other)

    def intersect(self, other: Frame) -> Frame:
        """Rows in both, each once."""
        return self._then("Intersect", data=self.data.intersect(other._aligned(self)))

    def except_(self, other: Frame) -> Frame:
        """Rows that aren't in the other, each once."""
        return self._then("Except", data=self.data.subtract(other._aligned(self)))

    def _aligned(self, like: Frame) -> DataFrame:
        mine = {s.output: s for s in self.slots}
        if set(mine) != {s.output for s in like.slots}:
            raise ValueError(f"columns differ: {sorted(mine)} and {sorted(s.output for s in like.slots)}")
        return self.data.select(*[F.col(f"`{mine[s.output].physical}`").alias(s.physical) for s in like.slots])

    # --- groups

    def group_by(self, *keys: str | Expr, **named: str | Expr) -> GroupedFrame:
        """Groups; null is a key of its own. Without keys: one group of all rows."""
        scope, items = self.scope, []
        for k in keys:
            e = col(k) if isinstance(k, str) else k
            if e.kind == "column" and (slot := scope.find(e.name)) is not None:
                alias, name = (slot.alias, e.name.partition(".")[2]) if "." in e.name and slot.alias else (None, e.name)
                items.append((Slot(alias, name, physical(alias, name)), F.col(f"`{slot.physical}`")))
            else:
                items.append((Slot(None, e.name, physical(None, e.name)), e.build(scope)))
        items += [(Slot(None, n, physical(None, n)), self._column(e)) for n, e in named.items()]
        return GroupedFrame(self, tuple(items))

    groupby = group_by

    def agg(self, *aggs: AggExpr, **named: AggExpr) -> Frame:
        return self.group_by().agg(*aggs, **named)

    def top_n_per_group(self, n: int, by: list[str | Expr], order: list[str | Expr], ascending: bool | list[bool] | None = None, rank_as: str | None = None) -> Frame:
        """The first n rows of each group, in an order; rank_as names a column for the place, from 1."""
        ranked = self.window(**{rank_as or "__rank": ("row_number", by, order, ascending)})
        slot = ranked.slots[-1]
        out = replace(ranked, data=ranked.data.filter(F.col(f"`{slot.physical}`") <= n), plan=(*self.plan, f"TopNPerGroup({n})"))
        return out if rank_as else out.drop("__rank")

    def window(self, **columns: tuple) -> Frame:
        """Columns over windows: name=(function, partition keys, order keys[, ascending]); function is row_number, rank,
        dense_rank, or (lag or lead, expression[, steps]), or an aggregate over the partition."""
        out = self
        for name, (f, by, order, *up) in columns.items():
            keys = self._order(order, up[0] if up else None)
            w = Window.partitionBy(*[self._column(k) for k in by])
            w = w.orderBy(*keys) if keys else w
            if isinstance(f, AggExpr):
                c = f.build(self.scope)
            elif isinstance(f, tuple):
                c = getattr(F, f[0])(self._column(f[1]), *(f[2:] or (1,)))
            else:
                c = getattr(F, f)()
            slot, c = Slot(None, name, physical(None, name)), c.over(w)
            c = c.cast("long") if isinstance(f, str) else c
            out = replace(out, data=out.data.withColumn(slot.physical, c), slots=(*out.slots, slot), plan=(*out.plan, f"Window({name})"))
        return out

    # --- results

    def to_df(self) -> DataFrame:
        """A DataFrame with output names, dotted ones as they are."""
        return self.data.select(*[F.col(f"`{s.physical}`").alias(s.output) for s in self.slots if not s.name.startswith("_bound_")])

    def collect(self, as_pandas: bool = False, as_arrow: bool = False, as_polars: bool = False) -> Any:
        """Dicts, or a pandas frame, an Arrow table or, where polars is installed, a polars frame."""
        df = self.to_df()
        if as_polars:
            import polars

            return polars.from_arrow(df.toArrow())
        if as_pandas:
            return df.toPandas()
        if as_arrow:
            return df.toArrow()
        return [r.asDict(recursive=True) for r in df.collect()]

    def count(self) -> int:
        return self.data.count()

    def first(self) -> dict | None:
        return next((r.asDict(recursive=True) for r in self.to_df().take(1)), None)

    def exists(self) -> bool:
        return not self.data.isEmpty()

    def write(self, path: str, format: str = "parquet", mode: str = "error", **options: Any) -> None:
        """Write the rows with a built-in format of Spark: parquet, orc, json, csv."""
        self.to_df().write.format(format).mode(mode).options(**options).save(path)

    def schema(self) -> FrameSchema:
        kinds = {f.name: type_name(f.dataType) for f in self.data.schema}
        labels = self.labels.get(self.current or self.root or "", ())
        return FrameSchema(tuple((s.output, kinds[s.physical]) for s in self.slots), self.entity, labels[0] if len(labels) == 1 else None)

    def profile(self) -> dict[str, Any]:
        """Run the query without keeping rows; its number of rows and seconds."""
        from pyspark.sql import Observation

        seen, began = Observation(), time.perf_counter()
        self.data.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        return {"rows": seen.get["rows"], "seconds": time.perf_counter() - began}

    def explain(self, mode: str = "logical") -> str:
        """The steps as written, Catalyst's optimised plan, the physical plan, or the plan with sizes."""
        if mode not in EXPLAIN:
            raise ValueError(f"explain is one of {', '.join(EXPLAIN)}")
        if mode == "logical":
            return "\n".join("  " * i + s for i, s in enumerate(reversed(self.plan)))
        q = self.data._jdf.queryExecution()
        if mode == "optimized":
            return q.optimizedPlan().toString()
        kind = self.graph.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted" if mode == "physical" else "cost")
        return q.explainString(kind)

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict(recursive=True) for r in self.to_df().toLocalIterator())

    def __len__(self) -> int:
        return self.count()

    # --- traversal

    def expand(self, edge: str | Iterable[str] | None = None, to: str | None = None, direction: str = "out", hops: int | tuple[int, int | None] | None = None, as_: str | None = None, edge_as: str | None = None, from_: str | None = None, edge_where: Expr | None = None, to_where: Expr | None = None, include_path: bool = False, path_properties: list[str] | None = None) -> NodeFrame:
        """Follow edges from the current node, or from the alias from_, to the nodes at the other end.

        One row for each edge that fits. direction both: either way, a loop once. hops: a number, or (least, most), most
        None without end; walks don't repeat an edge, and `_path` holds their nodes and edges. edge_where and
        to_where see the edge's and the target's columns by their bare names.
        """
        from .operators.traverse import expand

        return expand(self, edge, to, direction, hops, as_, edge_as, from_, edge_where, to_where, include_path, path_properties, "inner")

    def optional_expand(self, edge: str | Iterable[str] | None = None, to: str | None = None, direction: str = "out", hops: int | tuple[int, int | None] | None = None, as_: str | None = None, edge_as: str | None = None, from_: str | None = None, edge_where: Expr | None = None, to_where: Expr | None = None, include_path: bool = False, path_properties: list[str] | None = None) -> NodeFrame:
        """As expand, but rows without an edge that fits stay, with nulls."""
        from .operators.traverse import expand

        return expand(self, edge, to, direction, hops, as_, edge_as, from_, edge_where, to_where, include_path, path_properties, "left")

    def neighbors(self, direction: str = "both", as_: str = "neighbor") -> NodeFrame:
        return self.expand(direction=direction, as_=as_)

    def out_edges(self, edge: str | None = None, as_: str = "edge") -> Frame:
        """Edges from the current node, with their columns under an alias."""
        from .operators.traverse import edges_of

        return edges_of(self, edge, "out", as_)

    def in_edges(self, edge: str | None = None, as_: str = "edge") -> Frame:
        from .operators.traverse import edges_of

        return edges_of(self, edge, "in", as_)

    def degree(self, edge: str | None = None, direction: str = "both", as_: str = "degree") -> Frame:
        """The number of edges at the current node, 0 without any."""
        from .operators.traverse import degree

        return degree(self, edge, direction, as_)

    def expand_role(self, hyperedge: str, from_role: str, to_role: str, as_: str | None = None, edge_as: str | None = None) -> NodeFrame:
        """From nodes bound in one role to those that the same hyperedges bind in another."""
        from .operators.hyper import expand_role

        return expand_role(self, hyperedge, from_role, to_role, as_, edge_as)

    def hyperedges_of(self, hyperedge: str, role: str | None = None, as_: str | None = None) -> HyperedgeFrame:
        """The hyperedges that bind the current node, in a role or in any, as rows of their own."""
        from .operators.hyper import materialize

        return materialize(self, hyperedge, role, as_)


def _flagged(e: Expr, flags: dict[int, str]) -> Expr:
    """The predicate with exists() replaced by the flags that hold their results."""
    if id(e) in flags:
        return Expr("EXISTS", lambda s, n=flags[id(e)]: F.col(n))
    if not any(id(x) in flags for x in walk(e)):
        return e
    from .expr import OPERATORS

    parts = tuple(_flagged(p, flags) for p in e.parts)
    if e.kind in OPERATORS:
        return Expr(e.name, lambda s: OPERATORS[e.kind](*[p.build(s) for p in parts]), parts)
    if e.name == "NOT":
        return Expr("NOT", lambda s: ~parts[0].build(s), parts)
    raise ValueError("exists() stands in filter, alone or with & | ~")


class NodeFrame(Frame):
    entity = "node"


class PathFrame(Frame):
    entity = "path"


class EdgeFrame(Frame):
    """Edges: _id, _type, _src, _dst and properties under an alias."""

    entity = "edge"

    def source(self, as_: str | None = None) -> NodeFrame:
        return self._end("source", as_)

    def target(self, as_: str | None = None) -> NodeFrame:
        return self._end("target", as_)

    def endpoints(self, which: str = "both", as_: str | None = None) -> NodeFrame:
        """Nodes at the ends; both: a row for either end."""
        return self._end(which, as_)

    def _end(self, which: str, as_: str | None) -> NodeFrame:
        from .operators.traverse import endpoints

        return endpoints(self, which, as_)


class HyperedgeFrame(Frame):
    """Hyperedges: _id, _type, _arity, properties and bindings under an alias."""

    entity = "hyperedge"

    def where_role(self, role: str, value: Any) -> HyperedgeFrame:
        """Hyperedges that bind a node in a role: an id, a list of ids, or a frame of nodes."""
        from .operators.hyper import where_role

        return where_role(self, role, value)

    def expand(self, role: str, as_: str | None = None, to_where: Expr | None = None) -> HyperedgeFrame:  # type: ignore[override]
        """The nodes bound in a role, next to the hyperedge, from which other roles can be followed on."""
        from .operators.hyper import follow_role

        return follow_role(self, role, as_, to_where)

    def expand_hyperedge(self, role: str, as_: str | None = None) -> HyperedgeFrame:
        """The hyperedges bound in a role, next to the one that binds them; roles are then followed from them."""
        from .operators.hyper import follow_meta

        return follow_meta(self, role, as_)

    def roles(self) -> list[str]:
        """Names of the roles, in order."""
        names: set[str] = set()
        for t in self.graph.hyper_tables:
            if t.label in self.labels[self.root]:
                names |= {r.name for r in t.roles} if t.incidence is None else {r[0] for r in t.incidence.select("role").distinct().collect()}
        return sorted(names)


@dataclass(frozen=True)
class GroupedFrame:
    """Groups of a frame, to be aggregated."""

    frame: Frame
    keys: tuple[tuple[Slot, Column], ...]

    def agg(self, *aggs: AggExpr, **named: AggExpr) -> NodeFrame:
        f = self.frame
        scope, items = f.scope, [(Slot(None, a.name, physical(None, a.name)), a.build(scope)) for a in aggs]
        items += [(Slot(None, n, physical(None, n)), a.build(scope)) for n, a in named.items()]
        slots = [s for s, _ in self.keys] + [s for s, _ in items]
        if len({s.output for s in slots}) < len(slots):
            raise ValueError("agg: names differ from one another")
        keys = [c.alias(s.physical) for s, c in self.keys]
        outs = [c.alias(s.physical) for s, c in items]
        data = f.data.groupBy(*keys).agg(*outs) if outs else f.data.select(*keys).distinct()
        step = f"Aggregate(by=[{', '.join(s.output for s, _ in self.keys)}], [{', '.join(s.output for s, _ in items)}])"
        return NodeFrame(f.graph, data, tuple(slots), {}, f.labels, None, f.root, (*f.plan, step), f.params)

    def count(self, as_: str = "count") -> NodeFrame:
        return self.agg(**{as_: count_rows()})

    def _edge(self, order: list, ascending: bool) -> Frame:
        f = self.frame
        keys = f
        for i, (_, c) in enumerate(self.keys):
            slot = Slot(None, f"__g{i}", f"__g{i}")
            keys = replace(keys, data=keys.data.withColumn(slot.physical, c), slots=(*keys.slots, slot))
        names = [f"__g{i}" for i in range(len(self.keys))]
        out = keys.top_n_per_group(1, names, order, ascending)
        return out.drop(*names) if names else out

    def first(self, *order: str | Expr) -> Frame:
        """The whole row that is first in each group, in an order."""
        return self._edge(list(order), True)

    def last(self, *order: str | Expr) -> Frame:
        return self._edge(list(order), False)


# --- scans


def node_columns(data: DataFrame, alias: str, labels: tuple[str, ...], only: Iterable[str] | None = None) -> tuple[DataFrame, list[Slot]]:
    """A table of nodes with an alias's columns: _id, _labels, _label and properties."""
    props = [c for c in data.columns if not c.startswith("_") and (only is None or c in only)]
    slots = [Slot(alias, n, physical(alias, n)) for n in ("_id", "_labels", "_label", *props)]
    values = [F.col("_id"), F.array(*map(F.lit, labels)), F.lit(labels[0]), *[F.col(f"`{c}`") for c in props]]
    return data.select(*[v.alias(s.physical) for v, s in zip(values, slots, strict=True)]), slots


def nodes_as(graph: Hypergraph, label: str | None, alias: str) -> tuple[DataFrame, list[Slot], tuple[str, ...]]:
    """All nodes of a label, or of any, under an alias; properties that a table lacks are null."""
    tables = graph.tables_of(label)
    if not tables:
        raise ValueError(f"no nodes labelled {label!r}; there are {graph.node_labels()}")
    out, slots = node_columns(tables[0].data, alias, tables[0].labels)
    for t in tables[1:]:
        more, s = node_columns(t.data, alias, t.labels)
        out = out.unionByName(more, allowMissingColumns=True)
        slots += [x for x in s if x not in slots]
    return out, slots, tuple(dict.fromkeys(x for t in tables for x in t.labels)) if label is None else (label,)


def node_scan(graph: Hypergraph, label: str | None, alias: str | None) -> NodeFrame:
    alias = alias or label or "node"
    data, slots, labels = nodes_as(graph, label, alias)
    return NodeFrame(graph, data, tuple(slots), {alias: "node"}, {alias: labels}, alias, alias, (f"Scan(Node, {label or '*'})",))


def edge_scan(graph: Hypergraph, type: str | None, alias: str | None) -> EdgeFrame:
    tables = graph.all_edge_tables(None if type is None else [type])
    if not tables:
        raise ValueError(f"no edges of type {type!r}; there are {graph.edge_types()}")
    alias, out, slots = alias or type or "edge", None, []
    for t in tables:
        mine = [Slot(alias, n, physical(alias, n)) for n in ("_id", "_type", "_src", "_dst", "_src_label", "_dst_label", *t.properties)]
        values = [F.col("_id"), F.lit(t.type), F.col("_src"), F.col("_dst"), F.lit(t.src), F.lit(t.dst), *[F.col(f"`{c}`") for c in t.properties]]
        part = t.data.select(*[v.alias(s.physical) for v, s in zip(values, mine, strict=True)])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        slots += [s for s in mine if s not in slots]
    return EdgeFrame(graph, out, tuple(slots), {alias: "edge"}, {alias: tuple(sorted({t.type for t in tables}))}, None, alias, (f"Scan(Edge, {type or '*'})",))


def hyperedge_scan(graph: Hypergraph, label: str | None, alias: str | None) -> HyperedgeFrame:
    from .operators.hyper import headers

    tables = [t for t in graph.hyper_tables if label in (None, t.label)]
    if not tables:
        raise ValueError(f"no hyperedges labelled {label!r}; there are {graph.hyperedge_labels()}")
    alias = alias or label or "hyperedge"
    data, slots = headers(tables, alias)
    return HyperedgeFrame(graph, data, tuple(slots), {alias: "hyperedge"}, {alias: tuple(t.label for t in tables)}, None, alias, (f"Scan(Hyperedge, {label or '*'})",))
