"""Declared schemas, and what breaks them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .types import type_name

VIOLATION = "kind string, label string, property string, id bigint"


@dataclass(frozen=True)
class Property:
    """A property's type by name; required: must be a column; nullable: may be null."""

    type: str
    nullable: bool = True
    required: bool = False
    unique: bool = False


@dataclass(frozen=True)
class GraphSchema:
    """Declared properties by node label and edge type. strict: no others."""

    nodes: dict[str, dict[str, Property]] = field(default_factory=dict)
    edges: dict[str, dict[str, Property]] = field(default_factory=dict)
    strict: bool = False
    references: bool = False

    def violations(self, graph) -> DataFrame:
        """TypeMismatch, MissingRequiredProperty, UndeclaredProperty and MissingEntity have a null id when the whole table
        is meant; NullNotAllowed, NotUnique and DanglingReference name each row."""
        spark = graph.spark
        fixed, parts = [], []
        tables = [(t.label, t, self.nodes.get(t.label), t.data) for t in graph.node_tables] + [(t.type, t, self.edges.get(t.type), t.data) for t in graph.edge_tables]
        known = {x for t in graph.node_tables for x in t.labels} | {t.type for t in graph.edge_tables}
        fixed += [("MissingEntity", name, None, None) for name in [*self.nodes, *self.edges] if name not in known]
        for name, t, declared, df in tables:
            if declared is None:
                continue
            kinds = {f.name: type_name(f.dataType) for f in df.schema}
            for p, d in declared.items():
                if p not in kinds:
                    fixed += [("MissingRequiredProperty", name, p, None)] if d.required else []
                    continue
                if kinds[p] != d.type:
                    fixed.append(("TypeMismatch", name, p, None))
                here = [F.lit(name).alias("label"), F.lit(p).alias("property"), F.col("_id").alias("id")]
                if not d.nullable:
                    parts.append(df.filter(F.col(f"`{p}`").isNull()).select(F.lit("NullNotAllowed").alias("kind"), *here))
                if d.unique:
                    twice = df.groupBy(F.col(f"`{p}`").alias("__v")).agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1 and __v is not null")
                    parts.append(df.join(twice, F.col(f"`{p}`") == F.col("__v"), "left_semi").select(F.lit("NotUnique").alias("kind"), *here))
            if self.strict:
                fixed += [("UndeclaredProperty", name, p, None) for p in t.properties if p not in declared]
        if self.references:
            for t in graph.edge_tables:
                for end, label in (("_src", t.src), ("_dst", t.dst)):
                    there = [n.data.select(F.col("_id").alias(end)) for n in graph.tables_of(label)]
                    ids = there[0] if there else spark.createDataFrame([], f"{end} bigint")
                    for more in there[1:]:
                        ids = ids.unionAll(more)
                    parts.append(t.data.join(ids, end, "left_anti").select(F.lit("DanglingReference").alias("kind"), F.lit(t.type).alias("label"), F.lit(end).alias("property"), F.col("_id").alias("id")))
        out = spark.createDataFrame(fixed, VIOLATION)
        for p in parts:
            out = out.unionByName(p)
        return out
