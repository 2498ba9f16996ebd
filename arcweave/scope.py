"""Names of a frame's columns: how `alias.name` and `name` find a column."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ColumnNotFound(KeyError):
    """No column has the name."""


class AmbiguousColumn(KeyError):
    """More than one alias has a column of the name; qualify it."""


@dataclass(frozen=True)
class Slot:
    """A column: its alias (None for computed ones), its name and its name in the DataFrame."""

    alias: str | None
    name: str
    physical: str

    @property
    def output(self) -> str:
        return f"{self.alias}.{self.name}" if self.alias else self.name


def physical(alias: str | None, name: str) -> str:
    return (f"{alias}__{name}" if alias else name).replace(".", "__")


@dataclass(frozen=True)
class Scope:
    """The slots of a frame, and the kind of entity of each alias: node, edge, hyperedge or path."""

    df: DataFrame
    slots: tuple[Slot, ...]
    kinds: dict[str, str] = field(default_factory=dict)
    params: dict = field(default_factory=dict)

    def find(self, name: str) -> Slot | None:
        """The slot of a dotted or bare name; None if the name is an alias of an entity."""
        exact = [s for s in self.slots if s.alias is None and s.name == name]
        if exact:
            return exact[0]
        alias, dot, rest = name.partition(".")
        if dot:
            mine = {s.name: s for s in self.slots if s.alias == alias}
            if not mine:
                raise ColumnNotFound(f"no alias {alias!r}; there are {sorted(self.kinds)}")
            hit = mine.get(rest) or (mine.get("_id") if rest == "id" else None)
            if hit is None:
                raise ColumnNotFound(f"{alias!r} has no column {rest!r}; it has {sorted(mine)}")
            return hit
        names = [name, *({"path": ["_path"], "id": ["_id"]}.get(name, []))]
        for n in names:
            hits = [s for s in self.slots if s.name == n]
            if len(hits) > 1:
                raise AmbiguousColumn(f"{name!r} is in {sorted(s.output for s in hits)}")
            if hits:
                return hits[0]
        if name in self.kinds:
            return None
        raise ColumnNotFound(f"no column {name!r}; there are {sorted(s.output for s in self.slots)}")

    def column(self, name: str) -> Column:
        slot = self.find(name)
        return F.col(f"`{slot.physical}`") if slot else self.entity(name)

    def entity(self, alias: str) -> Column:
        """An entity as a struct of its columns."""
        mine = self.members(alias)
        return F.struct(*[F.col(f"`{s.physical}`").alias(s.name) for s in mine])

    def members(self, alias: str) -> list[Slot]:
        mine = [s for s in self.slots if s.alias == alias]
        if not mine:
            raise ColumnNotFound(f"no alias {alias!r}")
        return mine

    def type_of(self, c: Column) -> T.DataType | None:
        return self.df.select(c).schema[0].dataType

    def on(self, df: DataFrame, add: list[Slot] = (), kinds: dict | None = None) -> Scope:
        return replace(self, df=df, slots=(*self.slots, *add), kinds=self.kinds | (kinds or {}))


@dataclass(frozen=True)
class FieldScope:
    """The fields of a struct, as a predicate over the elements of a collection sees them."""

    value: Column

    def column(self, name: str) -> Column:
        return self.value["_id" if name == "id" else name]

    def type_of(self, c: Column) -> None:
        return None
