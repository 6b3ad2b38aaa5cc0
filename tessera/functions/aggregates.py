"""Aggregates: overloads by argument type. NULL inputs never count, and none left gives NULL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.functions.scalar import Expr
from tessera.types import FLOAT, INT, TAG, Type, list_of, optional, required


def int_avg(x: Column, s: Callable[[Column], Column], c: Callable[[Column], Column]) -> Column:
    """Truncating, as integers divide."""
    return F.call_function("div", s(x), F.nullif(c(x), F.lit(0)))


def values(kind: str) -> bool:
    return kind in ("Int", "Float", "Duration")


@dataclass(frozen=True)
class Aggregate:
    description: str
    accepts: Callable[[str], bool]
    result: Callable[[Type], Type]
    build: Callable[[Expr], Column]


def one(build: Callable[[Column], Column]) -> Callable[[Expr], Column]:
    return lambda e: build(e.col)


def average(distinct: bool) -> Callable[[Expr], Column]:
    s = F.sum_distinct if distinct else F.sum
    c = F.count_distinct if distinct else F.count

    def build(e: Expr) -> Column:
        if e.type.kind == "Int":
            return int_avg(e.col, s, c)
        return s(e.col) / F.nullif(c(e.col), F.lit(0))

    return build


def gathered(collect: Callable[[Column], Column]) -> Callable[[Expr], Column]:
    """Sorted; NULL rather than an empty list when there was no value."""
    def build(e: Expr) -> Column:
        items = F.sort_array(collect(e.col))
        return F.when(F.size(items) > 0, items)

    return build


ANY = lambda kind: True
SAME = lambda t: optional(t)
AGGREGATES: dict[str, Aggregate] = {
    "count": Aggregate("Number of values; NULL if there is none.", ANY, lambda t: optional(INT), one(lambda x: F.nullif(F.count(x), F.lit(0)))),
    "count_distinct": Aggregate("Number of distinct values.", ANY, lambda t: optional(INT), one(lambda x: F.nullif(F.count_distinct(x), F.lit(0)))),
    "sum": Aggregate("Sum.", values, SAME, one(F.sum)),
    "sum_distinct": Aggregate("Sum of the distinct values.", values, SAME, one(F.sum_distinct)),
    "avg": Aggregate("Mean; of integers truncated.", values, SAME, average(False)),
    "avg_distinct": Aggregate("Mean of the distinct values.", values, SAME, average(True)),
    "min": Aggregate("Least value.", lambda k: values(k) or k in ("Time", "String", "Boolean"), SAME, one(F.min)),
    "max": Aggregate("Greatest value.", lambda k: values(k) or k in ("Time", "String", "Boolean"), SAME, one(F.max)),
    "array_agg": Aggregate("Sorted list of the values.", ANY, lambda t: optional(list_of(required(t))), gathered(F.collect_list)),
    "array_agg_distinct": Aggregate("Sorted list of the distinct values.", ANY, lambda t: optional(list_of(required(t))), gathered(F.collect_set)),
}


def name_of(name: str, distinct: bool) -> str:
    return f"{name}_distinct" if distinct else name


def is_aggregate(name: str, distinct: bool = False) -> bool:
    return name_of(name, distinct) in AGGREGATES


def narrowed(name: str, e: Expr) -> Expr:
    """A union's only alternative that the aggregate takes; other values fail when met."""
    a = AGGREGATES.get(name)
    if a is None:
        raise QueryError(f"unknown aggregate: {name}({e.type})")
    if e.type.kind == "Union" and a.accepts is not ANY:
        own = [t for t in e.type.alts if a.accepts(t.kind)]
        if len(own) != 1:
            raise QueryError(f"unknown aggregate: {name}({e.type})")
        col = F.when(e.col[own[0].kind].isNotNull(), e.col[own[0].kind]).when(e.col.isNotNull(), F.raise_error(F.concat(F.lit(f"{name}: a value of another type, kind "), e.col[TAG].cast("string"))))
        return Expr(col, optional(own[0]))
    if e.type.kind != "Null" and not a.accepts(e.type.kind):
        raise QueryError(f"unknown aggregate: {name}({e.type})")
    return e


def aggregate(name: str, e: Expr) -> Expr:
    e = narrowed(name, e)
    a = AGGREGATES[name]
    if e.type.kind == "Null":
        result = a.result(FLOAT if name not in ("count", "count_distinct") else INT)
        return Expr(F.nullif(F.count(F.lit(None)), F.lit(0)).cast("bigint" if result.kind == "Int" else "double"), result)
    return Expr(a.build(e), a.result(e.type))


def running(name: str, e: Expr, w: WindowSpec) -> Column:
    """The aggregate over the records so far, for triggers that emit before the end."""
    e = narrowed(name, e)
    x = e.col
    if name == "count":
        return F.nullif(F.count(x).over(w), F.lit(0))
    if name == "sum":
        return F.sum(x).over(w)
    if name == "avg":
        total, n = F.sum(x).over(w), F.nullif(F.count(x).over(w), F.lit(0))
        return F.call_function("div", total, n) if e.type.kind == "Int" else total / n
    if name in ("min", "max"):
        return (F.min if name == "min" else F.max)(x).over(w)
    items = F.collect_list(x).over(w) if name == "array_agg" else F.collect_set(x).over(w)
    if name.startswith("array_agg"):
        return F.when(F.size(items) > 0, F.sort_array(items))
    if name == "count_distinct":
        return F.nullif(F.size(items), F.lit(0)).cast("bigint")
    zero = F.lit(0).cast("bigint") if e.type.kind == "Int" else F.lit(0.0)
    total = F.when(F.size(items) > 0, F.aggregate(items, zero, lambda a, b: a + b))
    if name == "sum_distinct":
        return total
    return F.call_function("div", total, F.nullif(F.size(items), F.lit(0)).cast("bigint")) if e.type.kind == "Int" else total / F.nullif(F.size(items), F.lit(0))


def so_far(keys: list[str], seq: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
