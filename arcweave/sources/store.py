"""Parquet snapshots of a graph with time travel, and transactions."""

from __future__ import annotations

import json
import re
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import EdgeTable, HyperTable, Hypergraph, NodeTable, Role
from .scratch import filesystem


def _safe(name: str) -> str:
    """A label as a folder name; others than letters, digits, - and _ are written as their code."""
    return re.sub(r"[^A-Za-z0-9_-]", lambda m: f"%{ord(m[0]):x}", name)


class Store:
    """A folder, on any file system that Spark reaches.

    snapshots/<number>/<kind>/<label>/ holds Parquet; manifest-<number>.json lists the tables of a snapshot, and those
    that didn't change point to the snapshot that wrote them. A snapshot is there once its manifest is,
    which is written under another name and renamed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- manifests

    def _read(self, path: str) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))

    def _write(self, path: str, value: dict) -> None:
        fs, p = filesystem(self.spark, path)
        _, tmp = filesystem(self.spark, path + ".tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(tmp, p):
            fs.delete(tmp, False)
            raise RuntimeError(f"{path} is there: another writer was first")

    def numbers(self) -> list[int]:
        fs, p = filesystem(self.spark, self.root)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def snapshots(self) -> list[dict]:
        """Number, parent and name of each snapshot."""
        return [{k: m.get(k) for k in ("snapshot", "parent", "name")} for n in self.numbers() for m in [self.manifest(n)]]

    def manifest(self, number: int) -> dict:
        return self._read(f"{self.root}/manifest-{number}.json")

    def resolve(self, snapshot: int | str | None) -> int:
        """The number of the latest snapshot, of a number or of a name (the last one of the name)."""
        known = self.numbers()
        if not known:
            raise FileNotFoundError(f"no snapshot in {self.root}")
        if snapshot is None:
            return known[-1]
        if isinstance(snapshot, int):
            if snapshot not in known:
                raise KeyError(f"no snapshot {snapshot}; there are {known}")
            return snapshot
        named = [n for n in known if self.manifest(n).get("name") == snapshot]
        if not named:
            raise KeyError(f"no snapshot named {snapshot!r}")
        return named[-1]

    # --- graphs

    def create(self) -> Hypergraph:
        return self.save(Hypergraph(self.spark)) if not self.numbers() else self.open()

    def open(self, snapshot: int | str | None = None) -> Hypergraph:
        m = self.manifest(self.resolve(snapshot))

        def read(x: dict) -> DataFrame:
            return self.spark.read.schema(T.StructType.fromJson(x["schema"])).parquet(f"{self.root}/{x['path']}")

        nodes = tuple(NodeTable(tuple(x["labels"]), read(x)) for x in m["nodes"])
        edges = tuple(EdgeTable(x["type"], x["src"], x["dst"], read(x)) for x in m["edges"])
        hypers = tuple(HyperTable(x["label"], read(x), tuple(Role(**r) for r in x["roles"]), read(x["incidence"]) if x.get("incidence") else None) for x in m["hyperedges"])
        origin = {}
        for kind, tables in (("nodes", nodes), ("edges", edges), ("hyperedges", hypers)):
            for x, t in zip(m[kind], tables, strict=True):
                origin[id(t.data)] = x
        out = Hypergraph(self.spark, nodes, edges, hypers, store=(self, m["snapshot"]))
        object.__setattr__(out, "origin", (origin, [t.data for t in (*nodes, *edges, *hypers)]))
        return out

    def save(self, graph: Hypergraph, name: str | None = None) -> Hypergraph:
        """Write a graph as the next snapshot; tables that it read from this store as they are aren't written again."""
        known = self.numbers()
        number = known[-1] + 1 if known else 0
        parent = graph.store[1] if graph.store else None
        origin = getattr(graph, "origin", ({}, []))[0]
        m: dict[str, Any] = {"snapshot": number, "parent": parent, "name": name, "nodes": [], "edges": [], "hyperedges": []}

        def put(df: DataFrame, kind: str, label: str, i: int) -> dict:
            path = f"snapshots/{number}/{kind}/{_safe(label)}-{i}"
            df.write.parquet(f"{self.root}/{path}")
            return {"path": path, "schema": json.loads(df.schema.json())}

        for i, t in enumerate(graph.node_tables):
            m["nodes"].append(origin.get(id(t.data)) or put(t.data, "nodes", t.label, i) | {"labels": list(t.labels)})
        for i, t in enumerate(graph.edge_tables):
            m["edges"].append(origin.get(id(t.data)) or put(t.data, "edges", t.type, i) | {"type": t.type, "src": t.src, "dst": t.dst})
        for i, t in enumerate(graph.hyper_tables):
            x = origin.get(id(t.data))
            if x is None:
                x = put(t.data, "hyperedges", t.label, i) | {"label": t.label, "roles": [r.__dict__ for r in t.roles]}
                if t.incidence is not None:
                    x["incidence"] = put(t.incidence, "incidence", t.label, i)
            m["hyperedges"].append(x)
        self._write(f"{self.root}/manifest-{number}.json", m)
        return self.open(number)

    def tag(self, snapshot: int | str | None, name: str) -> Hypergraph:
        """The snapshot once more under a name."""
        return self.save(self.open(snapshot), name)


class Ref(int):
    """The id of an entity that knows its label or type."""

    label: str

    def __new__(cls, id: int, label: str) -> Ref:
        out = super().__new__(cls, id)
        out.label = label
        return out


def _end(x: Ref | tuple[str, int]) -> tuple[str, int]:
    """(label, id) of a Ref or a pair."""
    if isinstance(x, Ref):
        return x.label, int(x)
    if isinstance(x, tuple) and len(x) == 2:
        return x[0], int(x[1])
    raise TypeError("an entity is what create_node gives, or (label, id)")


def _entity(target: Ref | str, id: int | None) -> tuple[str, int]:
    return _end(target) if id is None else (target, int(id))


class Transaction:
    """Writes that become one new snapshot (or, without a store, a new graph) when committed.

    Ids come after the largest there is. Deleting a node deletes the edges and hyperedges at it. As a context, it
    commits at the end and rolls back after an exception; then it's closed, and further use raises.
    """

    def __init__(self, graph: Hypergraph):
        self.graph, self.result = graph, None
        self._open, self._ops, self._next = True, [], None

    def _use(self) -> None:
        if not self._open:
            raise RuntimeError("the transaction is closed")

    def _id(self) -> int:
        if self._next is None:
            top = 0
            for t in (*self.graph.node_tables, *self.graph.edge_tables, *self.graph.hyper_tables):
                top = max(top, t.data.agg(F.max("_id")).first()[0] or 0)
            self._next = top
        self._next += 1
        return self._next

    def create_node(self, label: str, **properties: Any) -> Ref:
        self._use()
        i = Ref(self._id(), label)
        self._ops.append(("node", label, {"_id": int(i)} | properties))
        return i

    def create_edge(self, edge_type: str, source: Ref | tuple[str, int], target: Ref | tuple[str, int], **properties: Any) -> Ref:
        """source, target: what create_node gave, or (label, id)."""
        self._use()
        source, target = _end(source), _end(target)
        i = Ref(self._id(), edge_type)
        self._ops.append(("edge", (edge_type, source[0], target[0]), {"_id": int(i), "_src": source[1], "_dst": target[1]} | properties))
        return i

    def create_hyperedge(self, label: str, bindings: dict[str, Ref | tuple[str, int]] | list[tuple[str, str, int]], **properties: Any) -> Ref:
        """bindings: entity by role, or (role, label, id) where a role comes several times."""
        self._use()
        if isinstance(bindings, dict):
            bindings = [(role, *_end(x)) for role, x in bindings.items()]
        if len(bindings) < 2:
            raise ValueError("a hyperedge binds two or more")
        bindings = [(r, to, int(n)) for r, to, n in bindings]
        i = Ref(self._id(), label)
        self._ops.append(("hyper", label, {"_id": int(i)} | properties, bindings))
        return i

    def insert_nodes(self, label: str, data: DataFrame, id: str = "_id") -> None:
        """All rows of a frame, with their own ids."""
        self._use()
        self._ops.append(("nodes", label, data, id))

    def insert_edges(self, edge_type: str, data: DataFrame, src: tuple[str, str], dst: tuple[str, str], id: str | None = None) -> None:
        self._use()
        self._ops.append(("edges", edge_type, data, src, dst, id))

    def update(self, target: Ref | str, id: int | None = None, **properties: Any) -> None:
        """Set properties of a node, an edge or a hyperedge: what a create gave, or a label or type and an id."""
        self._use()
        self._ops.append(("update", *_entity(target, id), properties))

    def delete_node(self, target: Ref | str, id: int | None = None) -> None:
        self._use()
        self._ops.append(("drop node", *_entity(target, id)))

    def delete_edge(self, target: Ref | str, id: int | None = None) -> None:
        self._use()
        self._ops.append(("drop edge", *_entity(target, id)))

    def delete_hyperedge(self, target: Ref | str, id: int | None = None) -> None:
        self._use()
        self._ops.append(("drop hyper", *_entity(target, id)))

    def pending_count(self) -> int:
        return len(self._ops)

    def is_active(self) -> bool:
        return self._open

    def rollback(self) -> None:
        self._use()
        self._ops.clear()
        self._open = False

    def commit(self, name: str | None = None) -> Hypergraph:
        """Apply the writes in order; give the new graph."""
        self._use()
        g = self.graph
        for op in self._ops:
            g = getattr(self, "_" + op[0].replace(" ", "_"))(g, *op[1:])
        self._open = False
        if self.graph.store:
            object.__setattr__(g, "origin", getattr(self.graph, "origin", ({}, [])))
            g = self.graph.store[0].save(g, name)
        self.result = g
        return g

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, value, trace) -> bool:
        if self._open:
            self.rollback() if kind else self.commit()
        return False

    # --- single writes

    def _row(self, values: dict, like: DataFrame | None) -> DataFrame:
        names = {f.name: f.dataType for f in like.schema} if like is not None else {}
        df = self.graph.spark.range(1)
        cols = [F.lit(v).cast(names[k] if k in names else "long" if k in ("_id", "_src", "_dst") else _kind(v)).alias(k) for k, v in values.items()]
        return df.select(*cols)

    def _append(self, data: DataFrame | None, row: DataFrame) -> DataFrame:
        return row if data is None else data.unionByName(row, allowMissingColumns=True)

    def _node(self, g: Hypergraph, label: str, values: dict) -> Hypergraph:
        have = next((t for t in g.node_tables if t.label == label), None)
        new = NodeTable(have.labels if have else (label,), self._append(have and have.data, self._row(values, have and have.data)))
        return replace(g, node_tables=(*[t for t in g.node_tables if t is not have], new))

    def _edge(self, g: Hypergraph, kind: tuple, values: dict) -> Hypergraph:
        have = next((t for t in g.edge_tables if (t.type, t.src, t.dst) == kind), None)
        new = EdgeTable(*kind, self._append(have and have.data, self._row(values, have and have.data)))
        return replace(g, edge_tables=(*[t for t in g.edge_tables if t is not have], new))

    def _hyper(self, g: Hypergraph, label: str, values: dict, bindings: list) -> Hypergraph:
        have = next((t for t in g.hyper_tables if t.label == label), None)
        schema = "edge_id bigint, ord int, role string, target_kind string, target_label string, target_id bigint"
        rows = self.graph.spark.createDataFrame([(values["_id"], i, r, "node", to, n) for i, (r, to, n) in enumerate(bindings)], schema)
        old = None if have is None else (have.incidence if have.incidence is not None else have.bindings().drop("edge_type"))
        new = HyperTable(label, self._append(have and have.data, self._row(values, have and have.data)), (), self._append(old, rows))
        return replace(g, hyper_tables=(*[t for t in g.hyper_tables if t is not have], new))

    def _nodes(self, g: Hypergraph, label: str, data: DataFrame, id: str) -> Hypergraph:
        have = next((t for t in g.node_tables if t.label == label), None)
        new = Hypergraph(g.spark).with_nodes(label, data, id).node_tables[0]
        return replace(g, node_tables=(*[t for t in g.node_tables if t is not have], NodeTable(have.labels if have else (label,), self._append(have and have.data, new.data))))

    def _edges(self, g: Hypergraph, type: str, data: DataFrame, src: tuple, dst: tuple, id: str | None) -> Hypergraph:
        new = Hypergraph(g.spark).with_edges(type, data, src, dst, id).edge_tables[0]
        have = next((t for t in g.edge_tables if (t.type, t.src, t.dst) == (type, src[0], dst[0])), None)
        return replace(g, edge_tables=(*[t for t in g.edge_tables if t is not have], replace(new, data=self._append(have and have.data, new.data))))

    def _update(self, g: Hypergraph, label: str, id: int, values: dict) -> Hypergraph:
        def changed(df: DataFrame) -> DataFrame:
            kinds = {f.name: f.dataType for f in df.schema}
            out = df
            for k, v in values.items():
                old = F.col(f"`{k}`") if k in kinds else F.lit(None).cast(_kind(v))
                out = out.withColumn(k, F.when(F.col("_id") == id, F.lit(v).cast(kinds.get(k) or _kind(v))).otherwise(old))
            return out

        fix = lambda tables, name: tuple(replace(t, data=changed(t.data)) if name(t) == label else t for t in tables)
        return replace(g, node_tables=fix(g.node_tables, lambda t: t.label), edge_tables=fix(g.edge_tables, lambda t: t.type), hyper_tables=fix(g.hyper_tables, lambda t: t.label))

    def _drop_node(self, g: Hypergraph, label: str, id: int) -> Hypergraph:
        nodes = tuple(replace(t, data=t.data.filter(F.col("_id") != id)) if label in t.labels else t for t in g.node_tables)
        edges = tuple(replace(t, data=t.data.filter(~((F.lit(t.src == label) & (F.col("_src") == id)) | (F.lit(t.dst == label) & (F.col("_dst") == id))))) if label in (t.src, t.dst) else t for t in g.edge_tables)
        hypers = []
        for t in g.hyper_tables:
            at = t.bindings().filter((F.col("target_label") == label) & (F.col("target_kind") == "node") & (F.col("target_id") == id)).select(F.col("edge_id").alias("_id")).distinct()
            inc = None if t.incidence is None else t.incidence.join(at.withColumnRenamed("_id", "edge_id"), "edge_id", "left_anti")
            hypers.append(replace(t, data=t.data.join(at, "_id", "left_anti").select(*t.data.columns), incidence=inc))
        return replace(g, node_tables=nodes, edge_tables=edges, hyper_tables=tuple(hypers))

    def _drop_edge(self, g: Hypergraph, type: str, id: int) -> Hypergraph:
        return replace(g, edge_tables=tuple(replace(t, data=t.data.filter(F.col("_id") != id)) if t.type == type else t for t in g.edge_tables))

    def _drop_hyper(self, g: Hypergraph, label: str, id: int) -> Hypergraph:
        out = []
        for t in g.hyper_tables:
            if t.label == label:
                t = replace(t, data=t.data.filter(F.col("_id") != id), incidence=None if t.incidence is None else t.incidence.filter(F.col("edge_id") != id))
            out.append(t)
        return replace(g, hyper_tables=tuple(out))


def _kind(v: Any) -> str:
    """The type that a property's first value gives it."""
    kinds = ((bool, "boolean"), (int, "bigint"), (float, "double"), (str, "string"), (bytes, "binary"))
    return next((k for t, k in kinds if isinstance(v, t)), "string")
