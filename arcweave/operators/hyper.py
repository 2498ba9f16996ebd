"""Hyperedges: headers, and following their roles."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expr import Expr
from ..frames import Frame, HyperedgeFrame, NodeFrame, fresh, node_columns
from ..graph import HyperTable, Hypergraph
from ..scope import Scope, Slot, physical


def headers(tables: list[HyperTable], alias: str) -> tuple[DataFrame, list[Slot]]:
    """Hyperedges of some tables under an alias: _id, _type, _arity, properties, and bindings that are columns
    (as __<table column>, for the joins that follow roles)."""
    out, slots = None, []
    for t in tables:
        names = ["_id", "_type", "_arity", *t.properties]
        arity = F.lit(len(t.roles)) if t.incidence is None else F.col("__arity")
        data = t.data
        if t.incidence is not None:
            sizes = t.incidence.groupBy(F.col("edge_id").alias("_id")).agg(F.count(F.lit(1)).cast("int").alias("__arity"))
            data = data.join(sizes, "_id", "left").fillna(0, ["__arity"])
        values = [F.col("_id"), F.lit(t.label), arity, *[F.col(f"`{c}`") for c in t.properties]]
        names += [f"_bound_{r.column}" for r in t.roles]
        values += [F.col(f"`{r.column}`").cast("long") for r in t.roles]
        by = dict(zip(names, values, strict=True))  # a column bound in several roles is there once
        mine = [Slot(alias, n, physical(alias, n)) for n in by]
        part = data.select(*[v.alias(physical(alias, n)) for n, v in by.items()])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        slots += [s for s in mine if s not in slots]
    return out, slots


def _tables(frame: HyperedgeFrame) -> list[HyperTable]:
    return [t for t in frame.graph.hyper_tables if t.label in frame.labels[frame.root]]


def _bound(frame: HyperedgeFrame, role: str, kind: str = "node") -> list[tuple[str, DataFrame | None, str]]:
    """(label of what's bound, None or an incidence's rows (h_edge, h_target), column) for each binding with a role."""
    out = []
    for t in _tables(frame):
        if t.incidence is None:
            out += [(r.target, None, physical(frame.root, f"_bound_{r.column}")) for r in t.roles if r.name == role and r.kind == kind]
        else:
            rows = t.incidence.filter((F.col("role") == role) & (F.col("target_kind") == kind))
            for label in sorted(r[0] for r in rows.select("target_label").distinct().collect()):
                mine = rows.filter(F.col("target_label") == label)
                out.append((label, mine.select(F.col("edge_id").alias("h_edge"), F.col("target_id").alias("h_target"), F.lit(t.label).alias("h_type")), ""))
    if not out:
        raise ValueError(f"no role {role!r}; there are {frame.roles()}")
    return out


def where_role(frame: HyperedgeFrame, role: str, value: Any) -> HyperedgeFrame:
    """A semi-join on the bindings of the role, or a filter where bindings are columns and the value is given."""
    if isinstance(value, Frame):
        alias = value.current or value.root
        key = value.data.select(F.col(f"`{physical(alias, '_id')}`").alias("__k")).distinct()
        labels: tuple[str, ...] | None = value.labels.get(alias)
    else:
        ids = list(value) if isinstance(value, (list, tuple, set)) else [value]
        if not all(isinstance(i, int) and not isinstance(i, bool) for i in ids):
            raise TypeError("a role's value is an id, a list of ids or a frame of nodes")
        key, labels = None, None
    root, data, tests = frame.root, frame.data, []
    bound = [x for x in _bound(frame, role) if labels is None or any(x[0] in t.labels and set(labels) & set(t.labels) for t in frame.graph.node_tables)]
    for i, (_, rows, column) in enumerate(bound):
        if rows is None and key is None:
            tests.append(F.col(f"`{column}`").isin(*ids))
            continue
        # A semi-join where it is the only test; else a flag, so that equal rows stay as many as they are.
        alone, flag = len(bound) == 1, f"__bound_{i}"
        if rows is None:
            keys, meets = key.withColumnRenamed("__k", flag), F.col(f"`{column}`") == F.col(flag)
        else:
            hit = rows.filter(F.col("h_target").isin(*ids)) if key is None else rows.join(key, F.col("h_target") == F.col("__k"), "left_semi")
            keys = hit.select(F.col("h_edge").alias(flag), F.col("h_type").alias(f"{flag}_type")).distinct()
            meets = (F.col(f"`{physical(root, '_id')}`") == F.col(flag)) & (F.col(f"`{physical(root, '_type')}`") == F.col(f"{flag}_type"))
        data = data.join(keys, meets, "left_semi" if alone else "left")
        tests.append(F.lit(True) if alone else F.col(flag).isNotNull())
    test = reduce(lambda x, y: x | y, tests, F.lit(False))
    data = data.filter(test).select(*[F.col(f"`{s.physical}`") for s in frame.slots])
    return replace(frame, data=data, plan=(*frame.plan, f"WhereRole({role})"))


def _beside(frame: HyperedgeFrame, rows: DataFrame | None, column: str, right: DataFrame, alias: str) -> DataFrame:
    """The frame's rows joined to what a binding, a column or rows of an incidence, names among `right`."""
    to = F.col(f"`{physical(alias, '_id')}`")
    if rows is None:
        return frame.data.join(right, F.col(f"`{column}`") == to)
    here = (F.col(f"`{physical(frame.root, '_id')}`") == F.col("h_edge")) & (F.col(f"`{physical(frame.root, '_type')}`") == F.col("h_type"))
    return frame.data.join(rows, here).join(right, F.col("h_target") == to).drop("h_edge", "h_target", "h_type")


def follow_meta(frame: HyperedgeFrame, role: str, as_: str | None) -> HyperedgeFrame:
    """Join the hyperedges bound in the role; what follows starts from them."""
    alias = fresh(frame.kinds, as_ or role)
    if as_ and alias != as_:
        raise ValueError(f"the alias {as_!r} is taken")
    out, slots, labels = None, [], []
    for label, rows, column in _bound(frame, role, "hyperedge"):
        tables = [t for t in frame.graph.hyper_tables if t.label == label]
        if not tables:
            raise ValueError(f"no hyperedges labelled {label!r}; there are {frame.graph.hyperedge_labels()}")
        right, s = headers(tables, alias)
        part = _beside(frame, rows, column, right, alias)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        slots += [x for x in s if x not in slots]
        labels.append(label)
    keep = (*frame.slots, *slots)
    return replace(frame, data=out.select(*[F.col(f"`{s.physical}`") for s in keep]), slots=keep, kinds=frame.kinds | {alias: "hyperedge"}, labels=frame.labels | {alias: tuple(dict.fromkeys(labels))}, root=alias, plan=(*frame.plan, f"ExpandMeta({role} AS {alias})"))


def follow_role(frame: HyperedgeFrame, role: str, as_: str | None, where: Expr | None) -> HyperedgeFrame:
    """Join the nodes bound in the role; a hyperedge that binds several has a row for each."""
    alias = fresh(frame.kinds, as_ or role)
    if as_ and alias != as_:
        raise ValueError(f"the alias {as_!r} is taken")
    out, slots, labels = None, [], []
    for label, rows, column in _bound(frame, role):
        for t in frame.graph.tables_of(label):
            right, s = node_columns(t.data, alias, t.labels)
            if where is not None:
                right = right.filter(where.build(Scope(right, tuple(replace(x, alias=None) for x in s))))
            part = _beside(frame, rows, column, right, alias)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
            slots += [x for x in s if x not in slots]
            labels.append(label)
    keep = (*frame.slots, *slots)
    return replace(frame, data=out.select(*[F.col(f"`{s.physical}`") for s in keep]), slots=keep, kinds=frame.kinds | {alias: "node"}, labels=frame.labels | {alias: tuple(dict.fromkeys(labels))}, current=alias, plan=(*frame.plan, f"ExpandRole({role} AS {alias})"))


def _incident(graph: Hypergraph, hyperedge: str, role: str | None, labels: tuple[str, ...] | None) -> DataFrame:
    """(i_edge, i_ord, i_role, i_target): bindings of nodes of the labels, in a role or any."""
    out = None
    for t in graph.hyper_tables:
        if t.label == hyperedge:
            rows = t.bindings().filter("target_kind = 'node'")
            rows = rows if role is None else rows.filter(F.col("role") == role)
            rows = rows if labels is None else rows.filter(F.col("target_label").isin(*labels))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no hyperedges labelled {hyperedge!r}; there are {graph.hyperedge_labels()}")
    return out.select(F.col("edge_id").alias("i_edge"), F.col("ord").alias("i_ord"), F.col("role").alias("i_role"), F.col("target_id").alias("i_target"), F.col("target_label").alias("i_label"))


def expand_role(frame: Frame, hyperedge: str, from_role: str, to_role: str, as_: str | None, edge_as: str | None) -> NodeFrame:
    """Bindings as columns: a join with the hyperedges and one with the nodes; else by way of the incidence table."""
    from .traverse import start_of

    start = start_of(frame, None)
    mine = F.col(f"`{physical(start, '_id')}`")
    labels = frame.labels.get(start)
    edge_alias = edge_as or fresh(frame.kinds, hyperedge)
    tables = [t for t in frame.graph.hyper_tables if t.label == hyperedge]
    if not tables:
        raise ValueError(f"no hyperedges labelled {hyperedge!r}; there are {frame.graph.hyperedge_labels()}")
    if as_ and as_ in frame.kinds:
        raise ValueError(f"the alias {as_!r} is taken")
    alias, out, slots, reached = fresh(frame.kinds, as_ or to_role), None, [], []
    data, head = headers(tables, edge_alias)
    if all(t.incidence is None for t in tables):
        ways = [(a, b) for t in tables for i, a in enumerate(t.roles) for j, b in enumerate(t.roles) if i != j and a.name == from_role and b.name == to_role and (labels is None or a.target in labels)]
        for a, b in ways:
            for t in frame.graph.tables_of(b.target):
                right, s = node_columns(t.data, alias, t.labels)
                part = frame.data.join(data, mine == F.col(f"`{physical(edge_alias, f'_bound_{a.column}')}`"))
                part = part.join(right, F.col(f"`{physical(edge_alias, f'_bound_{b.column}')}`") == F.col(f"`{physical(alias, '_id')}`"))
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
                slots += [x for x in s if x not in slots]
                reached.append(b.target)
    else:
        one = _incident(frame.graph, hyperedge, from_role, labels)
        two = _incident(frame.graph, hyperedge, to_role, None).select(F.col("i_edge").alias("j_edge"), F.col("i_ord").alias("j_ord"), F.col("i_target").alias("j_target"), F.col("i_label").alias("j_label"))
        pairs = one.join(two, (F.col("i_edge") == F.col("j_edge")) & (F.col("i_ord") != F.col("j_ord")))
        for label in sorted(r[0] for r in two.select("j_label").distinct().collect()):
            for t in frame.graph.tables_of(label):
                right, s = node_columns(t.data, alias, t.labels)
                part = frame.data.join(pairs.filter(F.col("j_label") == label), mine == F.col("i_target"))
                part = part.join(data, F.col("i_edge") == F.col(f"`{physical(edge_alias, '_id')}`")).join(right, F.col("j_target") == F.col(f"`{physical(alias, '_id')}`"))
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
                slots += [x for x in s if x not in slots]
                reached.append(label)
    if out is None:
        raise ValueError(f"{hyperedge} has no way from {from_role!r} to {to_role!r}")
    keep = (*frame.slots, *(head if edge_as else ()), *slots)
    kinds = frame.kinds | {alias: "node"} | ({edge_as: "hyperedge"} if edge_as else {})
    return NodeFrame(frame.graph, out.select(*[F.col(f"`{s.physical}`") for s in keep]), keep, kinds, frame.labels | {alias: tuple(dict.fromkeys(reached))}, alias, frame.root, (*frame.plan, f"ExpandRole({start} {from_role} -[{hyperedge}]- {to_role} {alias})"), frame.params)


def materialize(frame: Frame, hyperedge: str, role: str | None, as_: str | None) -> HyperedgeFrame:
    """Rows of hyperedges that bind the current node, once for each binding; the node's columns stay."""
    from .traverse import start_of

    start = start_of(frame, None)
    alias = fresh(frame.kinds, as_ or hyperedge)
    tables = [t for t in frame.graph.hyper_tables if t.label == hyperedge]
    mine, labels = F.col(f"`{physical(start, '_id')}`"), frame.labels.get(start)
    if not tables:
        raise ValueError(f"no hyperedges labelled {hyperedge!r}; there are {frame.graph.hyperedge_labels()}")
    data, slots = headers(tables, alias)
    if all(t.incidence is None for t in tables):
        out = None
        for t in tables:
            for r in t.roles:
                if (role is None or r.name == role) and (labels is None or r.target in labels):
                    part = frame.data.join(data, mine == F.col(f"`{physical(alias, f'_bound_{r.column}')}`"))
                    out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError(f"{hyperedge} binds no {labels} in {role or 'any role'}")
    else:
        rows = _incident(frame.graph, hyperedge, role, labels)
        out = frame.data.join(rows, mine == F.col("i_target")).join(data, F.col("i_edge") == F.col(f"`{physical(alias, '_id')}`"))
    keep = (*frame.slots, *slots)
    return HyperedgeFrame(frame.graph, out.select(*[F.col(f"`{s.physical}`") for s in keep]), keep, frame.kinds | {alias: "hyperedge"}, frame.labels | {alias: (hyperedge,)}, start, alias, (*frame.plan, f"Materialize({hyperedge})"), frame.params)
