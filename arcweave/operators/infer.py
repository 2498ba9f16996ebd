"""Inference: Horn rules over binary edges, by semi-naive evaluation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EdgeTable, Hypergraph
from ..sources.scratch import stash, together, unstash

Atom = tuple[str, str, str]
MOST_ROUNDS = 10_000


@dataclass(frozen=True)
class Rule:
    """head holds if all of body do. An atom is (edge type, variable, variable); the head's variables occur in the body."""

    head: Atom
    body: tuple[Atom, ...]
    name: str = "rule"

    def __post_init__(self) -> None:
        object.__setattr__(self, "body", tuple(tuple(a) for a in self.body))
        bound = {v for a in self.body for v in a[1:]}
        if not self.body or not set(self.head[1:]) <= bound:
            raise ValueError(f"{self.name}: variables of the head occur in the body")


def facts(graph: Hypergraph, type: str) -> DataFrame | None:
    """(sl, s, dl, d): distinct ends of a type's edges."""
    out = None
    for t in graph.all_edge_tables([type]):
        part = t.data.select(F.lit(t.src).alias("sl"), F.col("_src").alias("s"), F.lit(t.dst).alias("dl"), F.col("_dst").alias("d"))
        out = part if out is None else out.unionByName(part)
    return None if out is None else out.distinct()


def fire(rule: Rule, sources: list[DataFrame]) -> DataFrame:
    """What a rule derives from one source of facts for each atom: joins on shared variables."""
    out, seen = None, set()
    for (_, a, b), df in zip(rule.body, sources, strict=True):
        part = df.select(F.col("sl").alias(f"{a}_l"), F.col("s").alias(f"{a}_i"), F.col("dl").alias("__l"), F.col("d").alias("__i"))
        if a == b:
            part = part.filter((F.col(f"{a}_l") == F.col("__l")) & (F.col(f"{a}_i") == F.col("__i"))).drop("__l", "__i")
        else:
            part = part.withColumnsRenamed({"__l": f"{b}_l", "__i": f"{b}_i"})
        shared = sorted({a, b} & seen)
        if out is None:
            out = part
        elif shared:
            out = out.join(part, [f"{v}_{x}" for v in shared for x in "li"])
        else:
            raise ValueError(f"{rule.name}: atoms of the body are linked by variables, each to one before it")
        seen |= {a, b}
    _, x, y = rule.head
    return out.select(F.col(f"{x}_l").alias("sl"), F.col(f"{x}_i").alias("s"), F.col(f"{y}_l").alias("dl"), F.col(f"{y}_i").alias("d")).distinct()


def derive(graph: Hypergraph, rules: Iterable[Rule], mode: str = "fixpoint", rounds: int | None = None) -> dict[str, DataFrame]:
    """By type, the derived ends (sl, s, dl, d) that weren't facts before.

    Each round joins what is new since the last, in one place of a body at a time, with all that is known in the others, and
    takes away the known. New facts and what is known are written to the shared folder, so plans stay short.
    """
    rules = list(rules)
    limit = {"standard": 1, "bounded": rounds, "fixpoint": MOST_ROUNDS}.get(mode)
    if limit is None:
        raise ValueError("mode is standard, bounded with rounds, or fixpoint")
    heads = {r.head[0] for r in rules}
    missing = {a[0] for r in rules for a in r.body} - set(graph.edge_types()) - heads
    if missing:
        raise ValueError(f"no edges of type {sorted(missing)}")
    empty = graph.spark.createDataFrame([], "sl string, s bigint, dl string, d bigint")
    names = {a[0] for r in rules for a in (r.head, *r.body)}
    # Rounds are only added to what is known; nothing is written twice.
    parts = {n: [stash(facts(graph, n) if n in graph.edge_types() else empty, "facts")] for n in names}
    known = {n: p[0] for n, p in parts.items()}
    new, derived = dict(known), {h: empty for h in heads}
    for k in range(limit):
        fresh: dict[str, DataFrame] = {}
        for r in rules:
            for i, atom in enumerate(r.body):
                if k == 0 and i:
                    break  # all is new in the first round: one place does
                if atom[0] not in new:
                    continue
                got = fire(r, [new[atom[0]] if j == i else known[a[0]] for j, a in enumerate(r.body)])
                fresh[r.head[0]] = fresh[r.head[0]].unionByName(got) if r.head[0] in fresh else got
        found = {}
        for h, df in fresh.items():
            more = stash(df.distinct().join(known[h], ["sl", "s", "dl", "d"], "left_anti"), "new")
            if more.isEmpty():
                unstash(more)
            else:
                found[h] = more
        if not found:
            return derived
        for h, more in found.items():
            parts[h].append(more)
            known[h], derived[h] = together(parts[h]), together(parts[h][1:])
        new = found
    if mode == "fixpoint":
        raise RuntimeError(f"no fixpoint within {MOST_ROUNDS} rounds")
    return derived


def infer(graph: Hypergraph, rules: Iterable[Rule], mode: str = "fixpoint", rounds: int | None = None) -> Hypergraph:
    """The graph with the derived edges, which have the properties derived (true) and rule (names of rules with that head)."""
    rules = list(rules)
    tables = list(graph.edge_tables)
    for type, df in derive(graph, rules, mode, rounds).items():
        names = ",".join(sorted({r.name for r in rules if r.head[0] == type}))
        for sl, dl in sorted((r[0], r[1]) for r in df.select("sl", "dl").distinct().collect()):  # as many as pairs of labels
            rows = df.filter((F.col("sl") == sl) & (F.col("dl") == dl))
            key = F.xxhash64(F.lit(type), "s", "d")
            tables.append(EdgeTable(type, sl, dl, rows.select(key.alias("_id"), F.col("s").alias("_src"), F.col("d").alias("_dst"), F.lit(True).alias("derived"), F.lit(names).alias("rule"))))
        if not any(t.type == type for t in tables):
            tables.append(EdgeTable(type, "", "", df.select(F.lit(0).cast("long").alias("_id"), F.col("s").alias("_src"), F.col("d").alias("_dst"), F.lit(True).alias("derived"), F.lit(names).alias("rule"))))
    return replace(graph, edge_tables=tuple(tables))
