"""Walks over many edges: ranges of hops, shortest and all paths, patterns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import Expr
from ..frames import Frame, NodeFrame, PathFrame, fresh, nodes_as
from ..graph import Hypergraph
from ..scope import Slot, physical
from ..sources.scratch import stash, together, unstash
from .traverse import _target_nodes, edge_types, hops, steps

#: Hops that become one plan of joins; longer walks write each round to the shared folder.
UNROLLED = 4
#: Rounds after which a search without an end raises.
MOST_ROUNDS = 10_000


def adjacency(graph: Hypergraph, types: list[str] | None, direction: str, labels: tuple[str, ...] | None, where: Expr | None, properties: Iterable[str] | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(f, fl, t, tl, e, tn) of every step, nodes (n, nl, s) and the properties that path nodes carry.

    e: struct of type and id; tn, s: struct of _id, _label and properties. properties None: all that
    the nodes which steps touch share in name; an empty list keeps rows narrow, and saves the join with the nodes.
    """
    found = steps(graph, types, direction, None, None)
    touched = tuple(dict.fromkeys(x for t, _ in found for x in (t.src, t.dst)))
    tables = [t for t in graph.node_tables if set(t.labels) & set(touched)]
    common = [p for p in (tables[0].properties if tables else []) if all(p in t.properties for t in tables)]
    names = common if properties is None else list(properties)
    hop = hops(graph, types, direction, None, None, (), where)
    nodes = None
    for t in tables:
        have = [F.col(f"`{p}`").alias(p) if p in t.properties else F.lit(None).cast(_type(tables, p)).alias(p) for p in names]
        for label in t.labels:
            if label in touched:
                part = t.data.select(F.col("_id").alias("n"), F.lit(label).alias("nl"), F.struct(F.col("_id"), F.lit(label).alias("_label"), *have).alias("s"))
                nodes = part if nodes is None else nodes.unionByName(part)
    if nodes is None:
        nodes = graph.spark.createDataFrame([], "n bigint, nl string, s struct<_id:bigint,_label:string>")
    step = hop.select(F.col("h_from").alias("f"), F.col("h_fl").alias("fl"), F.col("h_to").alias("t"), F.col("h_tl").alias("tl"), F.struct(F.col("h_type").alias("type"), F.col("h_eid").alias("id")).alias("e"))
    if names:
        step = step.join(nodes.select(F.col("n").alias("t"), F.col("nl").alias("tl"), F.col("s").alias("tn")), ["t", "tl"])
    else:
        step = step.withColumn("tn", F.struct(F.col("t").alias("_id"), F.col("tl").alias("_label")))
    return step, nodes, names


def _type(tables, name: str) -> T.DataType:
    return next((t.data.schema[name].dataType for t in tables if name in t.properties), T.NullType())


def _next(level: DataFrame, step: DataFrame, trail: bool = True) -> DataFrame:
    """Walks one step longer; a trail repeats no edge."""
    out = level.join(step, (F.col("n") == F.col("f")) & (F.col("nl") == F.col("fl")))
    if trail:
        out = out.filter(~F.array_contains("edges", F.col("e")))
    return out.select("b", "bl", F.col("t").alias("n"), F.col("tl").alias("nl"), F.concat("nodes", F.array("tn")).alias("nodes"), F.concat("edges", F.array("e")).alias("edges"))


def _begin(starts: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """Walks without a step: (b, bl, n, nl, nodes, edges)."""
    if names:
        starts = starts.join(nodes.select(F.col("n").alias("b"), F.col("nl").alias("bl"), F.col("s").alias("tn")), ["b", "bl"])
    else:
        starts = starts.withColumn("tn", F.struct(F.col("b").alias("_id"), F.col("bl").alias("_label")))
    none = F.array().cast("array<struct<type:string,id:bigint>>")
    return starts.select("b", "bl", F.col("b").alias("n"), F.col("bl").alias("nl"), F.array("tn").alias("nodes"), none.alias("edges"))


def walks(starts: DataFrame, step: DataFrame, nodes: DataFrame, names: list[str], least: int, most: int | None) -> DataFrame:
    """Trails of least to most steps from starts (b, bl). Few steps are one plan; others a loop, whose
    rounds are written to the shared folder until none is left."""
    level, out, k = _begin(starts, nodes, names), None, 0
    stored = most is None or most > UNROLLED
    while True:
        if k >= least:
            out = level if out is None else out.unionByName(level)
        if most is not None and k >= most:
            return out
        if k >= MOST_ROUNDS:
            raise RuntimeError(f"walks are still growing after {MOST_ROUNDS} steps; give a most number of hops")
        level, k = _next(level, step), k + 1
        if stored:
            level = stash(level, "walk")
            if level.isEmpty():
                return out if out is not None else level


def expand_walks(frame: Frame, start: str, edge, to, direction: str, hop_range: int | tuple[int, int | None], as_: str | None, edge_as: str | None, edge_where: Expr | None, to_where: Expr | None, properties: list[str] | None, how: str) -> NodeFrame:
    """Walks from the distinct starts alone, then joined to the frame's rows."""
    least, most = (hop_range, hop_range) if isinstance(hop_range, int) else hop_range
    if least < 0 or most is not None and (most < least or most == 0 and least > 0):
        raise ValueError("hops are (least, most) with 0 <= least <= most, or most None")
    graph, types = frame.graph, edge_types(edge)
    if edge_as:
        raise ValueError("edges of a walk are in _path")
    # A single type of steps within a label needs no properties at its inner nodes unless asked for.
    step, nodes, names = adjacency(graph, types, direction, None, edge_where, properties)
    found = steps(graph, types, direction, None, None)
    mine, my_label = F.col(f"`{physical(start, '_id')}`"), F.col(f"`{physical(start, '_label')}`")
    starts = frame.data.select(mine.alias("b"), my_label.alias("bl")).filter("b is not null").distinct()
    reached = tuple(dict.fromkeys([t.src if back else t.dst for t, back in found] + (list(frame.labels.get(start, ())) if least == 0 else [])))
    trail = walks(starts, step, nodes, names, least, most)
    alias = fresh(frame.kinds, as_ or to or (reached[0] if len(reached) == 1 else "target"))
    if as_ and alias != as_:
        raise ValueError(f"the alias {as_!r} is taken")
    right, slots, labels = _target_nodes(graph, to, reached, alias, to_where)
    paths = fresh({s.name for s in frame.slots}, "_path")
    trail = trail.withColumn(paths, F.struct("nodes", "edges")).select("b", "bl", "n", "nl", paths)
    meets = (F.col("n") == F.col(f"`{physical(alias, '_id')}`")) & (F.col("nl") == F.col(f"`{physical(alias, '_label')}`"))
    ends = trail.join(right, meets)
    data = frame.data.join(ends, (mine == F.col("b")) & (my_label == F.col("bl")), "inner" if how == "inner" else "left")
    keep = (*frame.slots, Slot(None, paths, paths), *slots)
    span = f"{least}..{'' if most is None else most}"
    name = f"Expand({start} -{direction}[{'|'.join(types or ['*'])}*{span}]- {alias})"
    return NodeFrame(graph, data.select(*[F.col(f"`{s.physical}`") for s in keep]), keep, frame.kinds | {alias: "node"}, frame.labels | {alias: labels}, alias, frame.root, (*frame.plan, name), frame.params)


def _ids(frame: Frame) -> tuple[DataFrame, str]:
    alias = frame.current or frame.root
    return frame.data.select(F.col(f"`{physical(alias, '_id')}`").alias("i"), F.col(f"`{physical(alias, '_label')}`").alias("il")).distinct(), alias


def _framed(graph: Hypergraph, start: Frame, end: Frame, trail: DataFrame, step: str) -> PathFrame:
    """Paths with the columns of both ends, as start.*, end.* and under the end's own label."""
    out = trail.withColumn("_path", F.struct("nodes", "edges")).withColumn("length", F.size("edges"))
    keep: list[Slot] = [Slot(None, "_path", "_path"), Slot(None, "length", "length")]
    kinds, labels = {}, {}
    for frame, alias, n, nl in ((start, "start", "b", "bl"), (end, "end", "n", "nl")):
        own = frame.labels.get(frame.current or frame.root, ())
        data, slots, _ = nodes_as(graph, own[0] if len(own) == 1 else None, alias)
        out = out.join(data, (F.col(n) == F.col(f"`{physical(alias, '_id')}`")) & (F.col(nl) == F.col(f"`{physical(alias, '_label')}`")))
        keep += slots
        kinds[alias], labels[alias] = "node", own
    own = labels["end"]
    if len(own) == 1 and own[0] not in kinds:
        keep += [replace(s, alias=own[0]) for s in keep if s.alias == "end"]
        kinds[own[0]], labels[own[0]] = "node", own
    names = dict.fromkeys(s.physical for s in keep)
    return PathFrame(graph, out.select(*[F.col(f"`{p}`") for p in names]), tuple(keep), kinds, labels, "end", "start", (step,))


def shortest_path(start: Frame, end: Frame, edge_type: str | Iterable[str] | None = None, max_hops: int | None = None, direction: str = "both", edge: str | Iterable[str] | None = None, path_properties: list[str] | None = None) -> PathFrame:
    """All paths of the least length from each start to each end node that it reaches; a node is no path to itself.

    Breadth first: a round takes each start's frontier one step on, without the nodes that it reached in an earlier
    round. Rounds are written to the shared folder, of which later ones read the ends alone, and end with an empty frontier or max_hops.
    """
    graph = start.graph
    step, nodes, names = adjacency(graph, edge_types(edge or edge_type), direction, None, None, path_properties)
    starts, _ = _ids(start)
    ends, _ = _ids(end)
    goal = ends.select(F.col("i").alias("n"), F.col("il").alias("nl"))
    level = _begin(starts.select(F.col("i").alias("b"), F.col("il").alias("bl")), nodes, names)
    level, out, k = stash(level, "path"), None, 0
    levels = [level]
    while max_hops is None or k < max_hops:
        seen = together(levels).select("b", "bl", "n", "nl")
        level = stash(_next(level, step, trail=False).join(seen, ["b", "bl", "n", "nl"], "left_anti"), "path")
        k += 1
        if level.isEmpty():
            unstash(level)
            break
        hit = level.join(goal, ["n", "nl"], "left_semi").select("b", "bl", "n", "nl", "nodes", "edges")
        out = hit if out is None else out.unionByName(hit)
        levels.append(level)
    out = levels[0].limit(0).select("b", "bl", "n", "nl", "nodes", "edges") if out is None else out
    return _framed(graph, start, end, out, f"ShortestPath({direction}, max {max_hops})")


def all_paths(start: Frame, end: Frame, edge_type: str | Iterable[str] | None = None, min_hops: int | None = None, max_hops: int | None = None, direction: str = "both", edge: str | Iterable[str] | None = None, path_properties: list[str] | None = None) -> PathFrame:
    """All trails of min_hops (1) to max_hops steps from start to end nodes; without max_hops, to their end."""
    graph = start.graph
    step, nodes, names = adjacency(graph, edge_types(edge or edge_type), direction, None, None, path_properties)
    starts, _ = _ids(start)
    ends, _ = _ids(end)
    trail = walks(starts.select(F.col("i").alias("b"), F.col("il").alias("bl")), step, nodes, names, 1 if min_hops is None else min_hops, max_hops)
    hit = trail.join(ends.select(F.col("i").alias("n"), F.col("il").alias("nl")), ["n", "nl"], "left_semi")
    return _framed(graph, start, end, hit, f"AllPaths({direction}, {min_hops or 1}..{max_hops or ''})")


@dataclass(frozen=True)
class Pattern:
    """A start label, steps by edge type and range, and an end label; a step may name the label that it ends at."""

    start_label: str | None = None
    legs: tuple[tuple[str | None, str, int, int | None, str | None], ...] = ()
    end_label: str | None = None

    def start(self, label: str) -> Pattern:
        return replace(self, start_label=label)

    def via(self, edge_type: str | None, direction: str = "out", to: str | None = None) -> Pattern:
        return replace(self, legs=(*self.legs, (edge_type, direction, 1, 1, to)))

    def hops(self, min_hops: int = 1, max_hops: int | None = None) -> Pattern:
        """The range of the last step; without max_hops, just min_hops or more."""
        if not self.legs:
            raise ValueError("hops follows via")
        kind, way, _, _, to = self.legs[-1]
        return replace(self, legs=(*self.legs[:-1], (kind, way, min_hops, max_hops, to)))

    def end(self, label: str) -> Pattern:
        return replace(self, end_label=label)


def match(graph: Hypergraph, pattern: Pattern) -> Frame:
    """The rows of a pattern: the start as `start`, inner nodes as n1, n2, ... and the end as `end`."""
    frame = graph.nodes(pattern.start_label, alias="start")
    for i, (kind, way, least, most, to) in enumerate(pattern.legs):
        last = i + 1 == len(pattern.legs)
        hop_range = None if (least, most) == (1, 1) else (least, most)
        frame = frame.expand(kind, to=pattern.end_label if last else to, direction=way, hops=hop_range, as_="end" if last else f"n{i + 1}")
    return frame


