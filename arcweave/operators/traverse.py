"""Traversal along binary edges, as joins."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expr import Expr
from ..frames import EdgeFrame, Frame, NodeFrame, fresh, nodes_as
from ..graph import EdgeTable, Hypergraph
from ..scope import Scope, Slot, physical

DIRECTIONS = ("out", "in", "both")


def edge_types(edge: str | Iterable[str] | None) -> list[str] | None:
    return None if edge is None else [edge] if isinstance(edge, str) else list(edge)


def labels_fit(graph: Hypergraph, table_label: str, wanted: tuple[str, ...] | None) -> bool:
    """Whether nodes of the table's label may have one of the labels wanted."""
    if wanted is None or table_label in wanted:
        return True
    return any(table_label in t.labels and set(t.labels) & set(wanted) for t in graph.node_tables)


def steps(graph: Hypergraph, types: list[str] | None, direction: str, source: tuple[str, ...] | None, target: tuple[str, ...] | None) -> list[tuple[EdgeTable, bool]]:
    """Edge tables that fit, and whether they're followed against their direction."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
    if types is not None and (unknown := set(types) - set(graph.edge_types())):
        raise ValueError(f"no edges of type {sorted(unknown)}; there are {graph.edge_types()}")
    out = []
    for t in graph.all_edge_tables(types):
        if direction != "in" and labels_fit(graph, t.src, source) and labels_fit(graph, t.dst, target):
            out.append((t, False))
        if direction != "out" and labels_fit(graph, t.dst, source) and labels_fit(graph, t.src, target):
            out.append((t, True))
    return out


def hops(graph: Hypergraph, types: list[str] | None, direction: str, source: tuple[str, ...] | None, target: tuple[str, ...] | None, properties: Iterable[str] | None = None, where: Expr | None = None) -> DataFrame:
    """(h_from, h_fl, h_to, h_tl, h_type, h_eid, h_src, h_dst, e_<property>...) of every edge in each way it may be
    followed. A loop that could be followed both ways is there once. where sees an edge's columns by name."""
    found, out = steps(graph, types, direction, source, target), None
    both = {id(t.data) for t, back in found if back} & {id(t.data) for t, back in found if not back}
    for t, back in found:
        keep = [p for p in t.properties if properties is None or p in properties]
        data = t.data
        if where is not None:
            names = ("_id", "_src", "_dst", *t.properties)
            data = data.filter(where.build(Scope(data, tuple(Slot(None, n, n) for n in names))))
        if back and id(t.data) in both and t.src == t.dst:
            data = data.filter("_src <> _dst")
        ends = ("_dst", "_src") if back else ("_src", "_dst")
        fl, tl = (t.dst, t.src) if back else (t.src, t.dst)
        part = data.select(
            F.col(ends[0]).alias("h_from"), F.lit(fl).alias("h_fl"), F.col(ends[1]).alias("h_to"), F.lit(tl).alias("h_tl"), F.lit(t.type).alias("h_type"),
            F.col("_id").alias("h_eid"), F.col("_src").alias("h_src"), F.col("_dst").alias("h_dst"), *[F.col(f"`{p}`").alias(f"e_{p}") for p in keep],
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        none = "h_from bigint, h_fl string, h_to bigint, h_tl string, h_type string, h_eid bigint, h_src bigint, h_dst bigint"
        return graph.spark.createDataFrame([], none)
    return out


def _labels_of(frame: Frame, alias: str) -> tuple[str, ...] | None:
    return frame.labels.get(alias)


def _same_label(graph: Hypergraph, found: list[tuple[EdgeTable, bool]], end: str, labels: tuple[str, ...]) -> bool:
    """Whether ids at an end of all steps are of one node table that is all the labels stand for, so that ids alone tell nodes apart."""
    tables = [t for t in graph.node_tables if set(t.labels) & set(labels)]
    names = {(t.dst if back == (end == "from") else t.src) for t, back in found}
    return len(tables) == 1 and names <= {*tables[0].labels}


def start_of(frame: Frame, from_: str | None) -> str:
    alias = from_ or frame.current
    if alias is None or frame.kinds.get(alias) != "node":
        raise ValueError(f"nothing to expand from: {alias!r} is no node here")
    return alias


def expand(frame: Frame, edge, to, direction, hop_range, as_, edge_as, from_, edge_where, to_where, include_path, path_properties, how: str) -> NodeFrame:
    graph, start = frame.graph, start_of(frame, from_)
    if hop_range not in (None, 1) or include_path:
        from .paths import expand_walks

        return expand_walks(frame, start, edge, to, direction, hop_range or 1, as_, edge_as, edge_where, to_where, path_properties, how)
    types, source = edge_types(edge), _labels_of(frame, start)
    target = None if to is None else (to,)
    if to is not None and not graph.tables_of(to):
        raise ValueError(f"no nodes labelled {to!r}; there are {graph.node_labels()}")
    found = steps(graph, types, direction, source, target)
    reached = tuple(dict.fromkeys((t.src if back else t.dst) for t, back in found))
    alias = fresh(frame.kinds, as_ or to or (reached[0] if len(reached) == 1 else "target"))
    if as_ and alias != as_:
        raise ValueError(f"the alias {as_!r} is taken")
    if edge_as and edge_as in frame.kinds:
        raise ValueError(f"the alias {edge_as!r} is taken")
    hop = hops(graph, types, direction, source, target, None if edge_as else (), edge_where)
    right, slots, labels = _target_nodes(graph, to, reached, alias, to_where)
    to_id, to_label = F.col(f"`{physical(alias, '_id')}`"), F.col(f"`{physical(alias, '_label')}`")
    meets = F.col("h_to") == to_id
    if not _same_label(graph, found, "to", labels):
        meets = meets & _label_match(graph, F.col("h_tl"), to_label)
    leaves = F.col("h_from") == F.col(f"`{physical(start, '_id')}`")
    if not _same_label(graph, found, "from", source or tuple(graph.node_labels())):
        leaves = leaves & _label_match(graph, F.col("h_fl"), F.col(f"`{physical(start, '_label')}`"))
    if how == "inner":
        data = frame.data.join(hop, leaves).join(right, meets)
    else:
        data = frame.data.join(hop.join(right, meets), leaves, "left")
    kinds = frame.kinds | {alias: "node"}
    new, extra = list(slots), []
    if edge_as:
        names = {"_id": "h_eid", "_type": "h_type", "_src": "h_src", "_dst": "h_dst"} | {c[2:]: c for c in hop.columns if c.startswith("e_")}
        extra = [Slot(edge_as, n, physical(edge_as, n)) for n in names]
        data = data.withColumnsRenamed({c: physical(edge_as, n) for n, c in names.items()})
        kinds |= {edge_as: "edge"}
    keep = (*frame.slots, *extra, *new)
    data = data.select(*[F.col(f"`{s.physical}`") for s in keep])
    step = f"{'OptionalExpand' if how == 'left' else 'Expand'}({start} -{direction}[{'|'.join(types or ['*'])}]- {alias}{':' + to if to else ''})"
    return NodeFrame(graph, data, keep, kinds, frame.labels | {alias: labels}, alias, frame.root, (*frame.plan, step), frame.params)


def _label_match(graph: Hypergraph, edge_end, node_label):
    """Whether the label at an edge's end is one of those of the node's table."""
    out = edge_end == node_label
    for t in graph.node_tables:
        if len(t.labels) > 1:
            out = out | ((node_label == t.label) & edge_end.isin(*t.labels))
    return out


def _target_nodes(graph: Hypergraph, to: str | None, reached: tuple[str, ...], alias: str, where: Expr | None) -> tuple[DataFrame, list[Slot], tuple[str, ...]]:
    """Nodes that a step may lead to: those of the label asked for, or of the labels at the edges' ends."""
    wanted = [to] if to is not None else list(reached)
    out, slots, labels = None, [], []
    done: set[int] = set()
    for label in wanted:
        for t in graph.tables_of(label):
            if id(t) in done:
                continue
            done.add(id(t))
            from ..frames import node_columns

            part, s = node_columns(t.data, alias, t.labels)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
            slots += [x for x in s if x not in slots]
        labels.append(label)
    if out is None:
        out, slots, _ = nodes_as(graph, None, alias)
        out, labels = out.limit(0), list(graph.node_labels())
    if where is not None:
        out = out.filter(where.build(Scope(out, tuple(replace(s, alias=None) for s in slots))))
    return out, slots, tuple(labels)


def edges_of(frame: Frame, edge: str | None, direction: str, as_: str) -> Frame:
    start = start_of(frame, None)
    graph, types, source = frame.graph, edge_types(edge), _labels_of(frame, start)
    found = steps(graph, types, direction, source, None)
    hop = hops(graph, types, direction, source, None)
    leaves = F.col("h_from") == F.col(f"`{physical(start, '_id')}`")
    if not _same_label(graph, found, "from", source or tuple(graph.node_labels())):
        leaves = leaves & _label_match(graph, F.col("h_fl"), F.col(f"`{physical(start, '_label')}`"))
    names = {"_id": "h_eid", "_type": "h_type", "_src": "h_src", "_dst": "h_dst"} | {c[2:]: c for c in hop.columns if c.startswith("e_")}
    slots = [Slot(as_, n, physical(as_, n)) for n in names]
    data = frame.data.join(hop, leaves).withColumnsRenamed({c: physical(as_, n) for n, c in names.items()})
    keep = (*frame.slots, *slots)
    return replace(frame, data=data.select(*[F.col(f"`{s.physical}`") for s in keep]), slots=keep, kinds=frame.kinds | {as_: "edge"}, plan=(*frame.plan, f"Edges({direction})"))


def degree(frame: Frame, edge: str | None, direction: str, as_: str) -> Frame:
    """Edges are counted by their ends before the join: one row a node is joined, however many edges a hub has."""
    start = start_of(frame, None)
    graph, types, source = frame.graph, edge_types(edge), _labels_of(frame, start)
    found = steps(graph, types, direction, source, None)
    hop = hops(graph, types, direction, source, None, ()).groupBy("h_from", "h_fl").agg(F.count(F.lit(1)).alias("h_n"))
    meets = F.col("h_from") == F.col(f"`{physical(start, '_id')}`")
    if not _same_label(graph, found, "from", source or tuple(graph.node_labels())):
        meets = meets & _label_match(graph, F.col("h_fl"), F.col(f"`{physical(start, '_label')}`"))
    else:
        hop = hop.groupBy("h_from").agg(F.sum("h_n").alias("h_n"))
    slot = Slot(None, as_, physical(None, as_))
    data = frame.data.join(hop, meets, "left").withColumn(slot.physical, F.coalesce("h_n", F.lit(0)).cast("long"))
    keep = (*frame.slots, slot)
    return replace(frame, data=data.select(*[F.col(f"`{s.physical}`") for s in keep]), slots=keep, plan=(*frame.plan, f"Degree({direction})"))


def endpoints(frame: EdgeFrame, which: str, as_: str | None) -> NodeFrame:
    if which not in ("source", "target", "both"):
        raise ValueError("endpoints are source, target or both")
    graph, edge = frame.graph, frame.root
    tables = graph.all_edge_tables(frame.labels[edge])
    ends = {"source": [("_src", "_src_label")], "target": [("_dst", "_dst_label")]}.get(which) or [("_src", "_src_label"), ("_dst", "_dst_label")]
    reached = tuple(dict.fromkeys(x for t in tables for x in ([t.src] if which == "source" else [t.dst] if which == "target" else [t.src, t.dst])))
    alias = as_ or fresh(frame.kinds, reached[0] if len(reached) == 1 else "node")
    right, slots, labels = _target_nodes(graph, None, reached, alias, None)
    out = None
    for end, label in ends:
        meets = F.col(f"`{physical(edge, end)}`") == F.col(f"`{physical(alias, '_id')}`")
        if len(reached) > 1:
            meets = meets & _label_match(graph, F.col(f"`{physical(edge, label)}`"), F.col(f"`{physical(alias, '_label')}`"))
        part = frame.data.join(right, meets)
        out = part if out is None else out.unionByName(part)
    keep = (*frame.slots, *slots)
    return NodeFrame(graph, out.select(*[F.col(f"`{s.physical}`") for s in keep]), keep, frame.kinds | {alias: "node"}, frame.labels | {alias: labels}, alias, frame.root, (*frame.plan, f"Endpoints({which})"), frame.params)
