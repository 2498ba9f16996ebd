"""Hypergraphs: registries of node, edge and hyperedge tables."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import GraphSchema


@dataclass(frozen=True)
class Executor:
    """Where queries are asked to run; Spark's master decides, so this only sets the number of shuffle partitions."""

    kind: str = "local"
    parallelism: int | None = None
    memory_limit: int | None = None

    @staticmethod
    def local(parallelism: int | None = None, memory_limit: int | None = None) -> Executor:
        return Executor("local", parallelism, memory_limit)

    @staticmethod
    def ray(num_workers: int | None = None, resources: dict | None = None) -> Executor:
        return Executor("cluster", num_workers)


def LocalExecutor(parallelism: int | None = None, memory_limit: int | None = None) -> Executor:  # noqa: N802
    return Executor.local(parallelism, memory_limit)


def RayExecutor(num_workers: int | None = None) -> Executor:  # noqa: N802
    return Executor.ray(num_workers)


@dataclass(frozen=True)
class NodeTable:
    """Nodes with the same labels, the first of which is the primary one: _id and typed properties."""

    labels: tuple[str, ...]
    data: DataFrame

    @property
    def label(self) -> str:
        return self.labels[0]

    @property
    def properties(self) -> list[str]:
        return [c for c in self.data.columns if not c.startswith("_")]


@dataclass(frozen=True)
class EdgeTable:
    """Binary edges of a type between two labels: _id, _src, _dst and properties.

    The labels are part of the table's definition, not of its rows: a traversal reads the tables that
    fit its labels and compares ids alone.
    """

    type: str
    src: str
    dst: str
    data: DataFrame

    @property
    def properties(self) -> list[str]:
        return [c for c in self.data.columns if not c.startswith("_")]


@dataclass(frozen=True)
class Role:
    """One binding of all hyperedges of a table: the role, what it binds and the column with the id."""

    name: str
    target: str
    column: str
    kind: str = "node"


@dataclass(frozen=True)
class HyperTable:
    """Hyperedges of a label: _id and properties, and their bindings.

    Bindings are columns of the table where all hyperedges have the same roles (`roles`), so a role is followed
    by one join; or rows of an incidence table (edge_id, ord, role, target_kind, target_label, target_id).
    A role may come several times.
    """

    label: str
    data: DataFrame
    roles: tuple[Role, ...] = ()
    incidence: DataFrame | None = None

    @property
    def properties(self) -> list[str]:
        bound = {r.column for r in self.roles if r.column.startswith("_")}
        return [c for c in self.data.columns if not c.startswith("_") and c not in bound]

    def bindings(self) -> DataFrame:
        """(edge_id, edge_type, ord, role, target_kind, target_label, target_id), a row a binding."""
        if self.incidence is not None:
            return self.incidence.withColumn("edge_type", F.lit(self.label)).select("edge_id", "edge_type", "ord", "role", "target_kind", "target_label", "target_id")
        each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r.name).alias("role"), F.lit(r.kind).alias("target_kind"), F.lit(r.target).alias("target_label"), F.col(f"`{r.column}`").cast("long").alias("target_id")) for i, r in enumerate(self.roles)])
        return self.data.select(F.col("_id").alias("edge_id"), F.lit(self.label).alias("edge_type"), F.explode(each).alias("b")).select("edge_id", "edge_type", "b.*").filter("target_id is not null")


@contextlib.contextmanager
def _tagged(spark: SparkSession, tag: str):
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


@dataclass(frozen=True)
class Hypergraph:
    """An immutable handle: tables by label, nothing read until a frame is asked for rows."""

    spark: SparkSession
    node_tables: tuple[NodeTable, ...] = ()
    edge_tables: tuple[EdgeTable, ...] = ()
    hyper_tables: tuple[HyperTable, ...] = ()
    namespace: str | None = None
    declared: GraphSchema = field(default_factory=GraphSchema)
    namespaces: dict = field(default_factory=dict, compare=False)
    store: object = None

    # --- building

    @staticmethod
    def connect(uri: str = "memory://", spark: SparkSession | None = None, namespace: str | None = None, snapshot: int | str | None = None, executor: str | Executor = "local") -> Hypergraph:
        """memory:// is an empty graph; any other address is a folder of Parquet snapshots, of which the latest is
        opened, or the one with the number or name given. Where queries run is up to Spark's master."""
        spark = spark or SparkSession.builder.getOrCreate()
        if isinstance(executor, Executor) and executor.parallelism:
            spark.conf.set("spark.sql.shuffle.partitions", str(executor.parallelism))
        if uri.startswith(("memory://", "local://")) or uri == "local":
            return Hypergraph(spark, namespace=namespace)
        from .sources.store import Store

        out = Store(spark, uri).open(snapshot)
        return out.with_namespace(namespace) if namespace else out

    @staticmethod
    def create(uri: str = "memory://", spark: SparkSession | None = None, executor: str = "local") -> Hypergraph:
        """An empty graph; at a folder, with an empty first snapshot."""
        spark = spark or SparkSession.builder.getOrCreate()
        if uri.startswith(("memory://", "local://")) or uri == "local":
            return Hypergraph(spark)
        from .sources.store import Store

        return Store(spark, uri).create()

    def with_namespace(self, name: str) -> Hypergraph:
        """The graph of a namespace: a separate registry under the same handle, empty at first."""
        kept = self.namespaces | {self.namespace: (self.node_tables, self.edge_tables, self.hyper_tables)}
        nodes, edges, hypers = kept.get(name, ((), (), ()))
        return replace(self, namespace=name, node_tables=nodes, edge_tables=edges, hyper_tables=hypers, namespaces=kept)

    def with_config(self, parallelism: int | None = None, memory_limit: int | None = None, batch_size: int | None = None) -> Hypergraph:
        """parallelism: shuffle partitions. batch_size: rows of a columnar batch. Memory is set when the cluster starts."""
        if parallelism:
            self.spark.conf.set("spark.sql.shuffle.partitions", str(parallelism))
        if batch_size:
            self.spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(batch_size))
        return self

    def with_schema(self, declared: GraphSchema) -> Hypergraph:
        return replace(self, declared=declared)

    def with_nodes(self, label: str | Iterable[str], data: DataFrame, id: str = "_id") -> Hypergraph:
        """Add nodes; the id column is kept as a property too unless it is _id."""
        labels = (label,) if isinstance(label, str) else tuple(label)
        cols = [F.col(f"`{id}`").cast("long").alias("_id"), *[F.col(f"`{c}`") for c in data.columns if c != "_id"]]
        return replace(self, node_tables=(*self.node_tables, NodeTable(labels, data.select(*cols))))

    def with_edges(self, type: str, data: DataFrame, src: tuple[str, str], dst: tuple[str, str], id: str | None = None, properties: Iterable[str] | None = None) -> Hypergraph:
        """Add edges. src, dst: (label, column with the id). id: a column, or a hash of ends and properties."""
        keep = [c for c in data.columns if c not in (src[1], dst[1], id) and not c.startswith("_")] if properties is None else list(properties)
        ends = [F.col(f"`{src[1]}`").cast("long"), F.col(f"`{dst[1]}`").cast("long")]
        key = F.col(f"`{id}`").cast("long") if id else F.xxhash64(*ends, *[F.col(f"`{c}`") for c in keep])
        rows = data.select(key.alias("_id"), ends[0].alias("_src"), ends[1].alias("_dst"), *[F.col(f"`{c}`") for c in keep])
        rows = rows.filter("_src is not null and _dst is not null")
        return replace(self, edge_tables=(*self.edge_tables, EdgeTable(type, src[0], dst[0], rows)))

    def with_hyperedges(self, label: str, data: DataFrame, roles: Iterable[tuple[str, str, str]] = (), id: str | None = None, incidence: DataFrame | None = None) -> Hypergraph:
        """Add hyperedges. roles: (role, label of what it binds, column with the id), or an incidence table.

        The id is the column named, else `_id` if there is one, else a hash of all columns; rows equal in all of them share it.
        """
        id = id or ("_id" if "_id" in data.columns else None)
        if id is None and incidence is not None:
            raise ValueError("an incidence table needs hyperedges with an id column")
        key = F.col(f"`{id}`").cast("long") if id else F.xxhash64(*[F.col(f"`{c}`") for c in data.columns])
        rows = data.select(key.alias("_id"), *[F.col(f"`{c}`") for c in data.columns if c != "_id"])
        return replace(self, hyper_tables=(*self.hyper_tables, HyperTable(label, rows, tuple(Role(*r) for r in roles), incidence)))

    # --- frames

    def nodes(self, label: str | None = None, alias: str | None = None):
        """Nodes of a label, or all, as a frame under the alias, the label or `node`."""
        from .frames import node_scan

        return node_scan(self, label, alias)

    def edges(self, type: str | None = None, alias: str | None = None):
        """Binary edges of a type, or all. Hyperedges of two bindings, source and target, both nodes, are among them."""
        from .frames import edge_scan

        return edge_scan(self, type, alias)

    def hyperedges(self, label: str | None = None, alias: str | None = None):
        from .frames import hyperedge_scan

        return hyperedge_scan(self, label, alias)

    def match(self, pattern):
        """Paths that fit a Pattern."""
        from .operators.paths import match

        return match(self, pattern)

    def infer(self, rules, mode: str = "fixpoint", rounds: int | None = None) -> Hypergraph:
        """The graph with the edges that rules derive: standard (once), bounded (rounds) or fixpoint."""
        from .operators.infer import infer

        return infer(self, rules, mode, rounds)

    def tagged(self, tag: str):
        """A context whose queries Hypergraph.cancel(tag), called from another thread, stops."""
        return _tagged(self.spark, tag)

    def cancel(self, tag: str) -> None:
        self.spark.interruptTag(tag)

    def transaction(self):
        from .sources.store import Transaction

        return Transaction(self)

    # --- lookups

    def tables_of(self, label: str | None) -> list[NodeTable]:
        return [t for t in self.node_tables if label is None or label in t.labels]

    def all_edge_tables(self, types: Iterable[str] | None = None) -> list[EdgeTable]:
        """Edge tables, and two-role hyperedges as edges, of the types given or all."""
        wanted = None if types is None else set(types)
        found = [t for t in self.edge_tables if wanted is None or t.type in wanted]
        for h in self.hyper_tables:
            by = {r.name: r for r in h.roles}
            if (wanted is None or h.label in wanted) and len(h.roles) == 2 and set(by) == {"source", "target"} and all(r.kind == "node" for r in h.roles):
                s, t = by["source"], by["target"]
                cols = [F.col("_id"), F.col(f"`{s.column}`").cast("long").alias("_src"), F.col(f"`{t.column}`").cast("long").alias("_dst")]
                found.append(EdgeTable(h.label, s.target, t.target, h.data.select(*cols, *[F.col(f"`{c}`") for c in h.properties if c not in (s.column, t.column)])))
        return found

    def node_labels(self) -> list[str]:
        return sorted({x for t in self.node_tables for x in t.labels})

    def edge_types(self) -> list[str]:
        return sorted({t.type for t in self.all_edge_tables()})

    def hyperedge_labels(self) -> list[str]:
        return sorted({t.label for t in self.hyper_tables})

    def node_properties(self, label: str) -> list[str]:
        return sorted({p for t in self.tables_of(label) for p in t.properties})

    def edge_properties(self, type: str) -> list[str]:
        return sorted({p for t in self.all_edge_tables([type]) for p in t.properties})

    def node_count(self, label: str | None = None) -> int:
        return sum(t.data.count() for t in self.tables_of(label))

    def edge_count(self, type: str | None = None) -> int:
        return sum(t.data.count() for t in self.all_edge_tables(None if type is None else [type]))

    def hyperedge_count(self, label: str | None = None) -> int:
        return sum(t.data.count() for t in self.hyper_tables if label in (None, t.label))

    def adjacency(self, type: str | None = None, direction: str = "out") -> DataFrame:
        """(anchor_label, anchor_id, neighbor_label, neighbor_id, edge_type, edge_id)."""
        from .operators.traverse import hops

        found = hops(self, None if type is None else [type], direction, None, None, ())
        return found.select(F.col("h_fl").alias("anchor_label"), F.col("h_from").alias("anchor_id"), F.col("h_tl").alias("neighbor_label"), F.col("h_to").alias("neighbor_id"), F.col("h_type").alias("edge_type"), F.col("h_eid").alias("edge_id"))

    def subgraph(self, where: dict[str, Column | str]) -> Hypergraph:
        """The view of nodes that meet a condition by label, with the edges and hyperedges whose bound nodes all stay."""
        kept = tuple(replace(t, data=t.data.filter(where[t.label])) if t.label in where else t for t in self.node_tables)
        ids = {t.label: t.data.select("_id") for t in kept if t.label in where}

        def only(df: DataFrame, label: str, column: str) -> DataFrame:
            return df.join(ids[label].withColumnRenamed("_id", column), column, "left_semi") if label in ids else df

        edges = tuple(replace(t, data=only(only(t.data, t.src, "_src"), t.dst, "_dst").select(*t.data.columns)) for t in self.edge_tables)
        hypers = []
        for h in self.hyper_tables:
            data = h.data
            for r in h.roles:
                if r.target in ids:
                    key = ids[r.target].withColumnRenamed("_id", "__k")
                    data = data.join(key, data[r.column].cast("long") == key["__k"], "left_semi")
            if h.incidence is not None:
                for label, key in ids.items():
                    lost = h.incidence.filter((F.col("target_label") == label) & (F.col("target_kind") == "node")).join(key.withColumnRenamed("_id", "target_id"), "target_id", "left_anti")
                    data = data.join(lost.select(F.col("edge_id").alias("_id")), "_id", "left_anti")
            hypers.append(replace(h, data=data))
        return replace(self, node_tables=kept, edge_tables=edges, hyper_tables=tuple(hypers))

    def violations(self) -> DataFrame:
        """Rows that break the declared schema, as data: (kind, label, property, id)."""
        return self.declared.violations(self)
