"""Relations of the analyzer: a DataFrame with unique column names, and what they are called."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.functions.scalar import Expr
from tessera.types import Type, from_spark, normal

_ids = itertools.count()


def fresh(name: str) -> str:
    clean = "".join(c if c.isalnum() or c == "_" else "_" for c in name)
    return f"{clean}__{next(_ids)}"


@dataclass(frozen=True)
class Col:
    qualifier: str | None
    name: str
    internal: str
    type: Type

    @property
    def expr(self) -> Expr:
        return Expr(F.col(self.internal), self.type)


@dataclass
class Emission:
    """What a trigger needs to replay a grouped result as a change stream."""

    source: DataFrame
    keys: list[tuple[str, object]]
    aggs: list[tuple[str, str, Expr]]
    triggers: list
    time_key: str | None
    seq: str


@dataclass
class Relation:
    df: DataFrame
    cols: list[Col]
    #: internal name of the event time, and of the column of arrival, if known
    time: str | None = None
    seq: str | None = None
    emission: Emission | None = None
    window: str | None = None

    def find(self, name: str, qualifier: str | None = None) -> Col | None:
        found = [c for c in self.cols if c.name == name and (qualifier is None or c.qualifier == qualifier)]
        if not found:
            found = [c for c in self.cols if c.name.lower() == name.lower() and (qualifier is None or (c.qualifier or "").lower() == qualifier.lower())]
        if len(found) > 1 and qualifier is None and len({c.internal for c in found}) > 1:
            raise QueryError(f"ambiguous column {name}: {', '.join(f'{c.qualifier}.{c.name}' for c in found)}")
        return found[0] if found else None

    def aliased(self, alias: str | None) -> Relation:
        return replace(self, cols=[replace(c, qualifier=alias) for c in self.cols]) if alias else self

    def distinct_names(self) -> Relation:
        """The same with new internal names, so that a table can be used twice."""
        new = [replace(c, internal=fresh(c.name)) for c in self.cols]
        renamed = {c.internal: n.internal for c, n in zip(self.cols, new, strict=True)}
        extra = [x for x in (self.time, self.seq, self.window) if x and x not in renamed]
        for x in dict.fromkeys(extra):
            renamed[x] = fresh("extra")
        df = self.df.select(*[F.col(a).alias(b) for a, b in renamed.items()])
        return Relation(df, new, renamed.get(self.time), renamed.get(self.seq), None, renamed.get(self.window))


def from_frame(df: DataFrame, alias: str | None, types: dict[str, Type] | None = None, seq: str | None = None, time: str | None = None) -> Relation:
    """A stored table: columns in the dialect's types under new names."""
    cols, out = [], []
    for f in df.schema.fields:
        t = (types or {}).get(f.name) or from_spark(f.dataType, f.nullable)
        c = Col(alias, f.name, fresh(f.name), t)
        out.append(normal(F.col(f"`{f.name}`"), f.dataType).alias(c.internal))
        cols.append(c)
    by = {c.name: c.internal for c in cols}
    if seq and seq not in by:
        raise QueryError(f"unknown column of arrival: {seq}")
    return Relation(df.select(*out), cols, by.get(time) if time else None, by.get(seq) if seq else None)


@dataclass
class Scope:
    """What names mean: the current relation, outer ones (correlation) and common table expressions."""

    relation: Relation | None = None
    outer: Scope | None = None
    ctes: dict[str, object] = field(default_factory=dict)
