"""The dialect's types and how they lie in Spark columns.

A nullable T is a type of its own (`NULL | T`). A union of several types is a
struct whose first field tells the kind and whose other fields hold the value, one
for each alternative, so unions can be grouped and sorted: kinds sort first.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

KINDS = ("Null", "Int", "Float", "Boolean", "String", "Time", "Duration", "List", "Struct", "Tuple", "Union")
TAG = "__t"


@dataclass(frozen=True)
class Type:
    kind: str
    nullable: bool = False
    elem: Type | None = None
    fields: tuple[tuple[str, Type], ...] = ()
    alts: tuple[Type, ...] = ()

    def __str__(self) -> str:
        if self.kind == "Null":
            return "NULL"
        if self.kind == "List":
            s = f"[{self.elem or ''}]"
        elif self.kind == "Struct":
            s = "{" + "; ".join(f"{n}: {t}" for n, t in self.fields) + "}"
        elif self.kind == "Tuple":
            s = "(" + ", ".join(str(t) for _, t in self.fields) + ")"
        elif self.kind == "Union":
            s = " | ".join(map(str, self.alts))
        else:
            s = self.kind
        return f"NULL | {s}" if self.nullable else s


NULL = Type("Null", True)
INT, FLOAT, BOOLEAN, STRING, TIME, DURATION = (Type(k) for k in KINDS[1:7])


def list_of(t: Type | None) -> Type:
    return Type("List", elem=t)


def optional(t: Type) -> Type:
    return t if t.nullable else replace(t, nullable=True)


def required(t: Type) -> Type:
    return replace(t, nullable=False) if t.nullable and t.kind != "Null" else t


def alternatives(t: Type) -> tuple[Type, ...]:
    return t.alts if t.kind == "Union" else () if t.kind == "Null" else (required(t),)


def type_sum(a: Type, b: Type) -> Type:
    """The least type that holds both: structs and lists merge deeply, one alternative per kind."""
    nullable = a.nullable or b.nullable
    by: dict[str, Type] = {}
    for t in (*alternatives(a), *alternatives(b)):
        by[t.kind] = merge_kind(by[t.kind], t) if t.kind in by else t
    own = tuple(sorted(by.values(), key=lambda t: KINDS.index(t.kind)))
    if not own:
        return NULL
    return replace(own[0], nullable=nullable) if len(own) == 1 else Type("Union", nullable, alts=own)


def merge_kind(a: Type, b: Type) -> Type:
    if a.kind == "List":
        return list_of(a.elem if b.elem is None else b.elem if a.elem is None else type_sum(a.elem, b.elem))
    if a.kind == "Struct":
        fa, fb = dict(a.fields), dict(b.fields)
        if fa == fb:
            return a
        return Type("Struct", fields=tuple((n, type_sum(fa.get(n, NULL), fb.get(n, NULL))) for n in sorted({*fa, *fb})))
    if a.kind == "Tuple":
        n = max(len(a.fields), len(b.fields))
        part = lambda t, i: t.fields[i][1] if i < len(t.fields) else NULL
        return Type("Tuple", fields=tuple((f"_{i + 1}", type_sum(part(a, i), part(b, i))) for i in range(n)))
    return a


def to_spark(t: Type) -> S.DataType:
    simple = {"Null": S.NullType(), "Int": S.LongType(), "Float": S.DoubleType(), "Boolean": S.BooleanType(), "String": S.StringType(), "Time": S.TimestampType(), "Duration": S.DayTimeIntervalType()}
    if t.kind in simple:
        return simple[t.kind]
    if t.kind == "List":
        return S.ArrayType(to_spark(t.elem or NULL))
    if t.kind == "Union":
        return S.StructType([S.StructField(TAG, S.ByteType()), *[S.StructField(a.kind, to_spark(a)) for a in t.alts]])
    return S.StructType([S.StructField(n, to_spark(f)) for n, f in t.fields])


def from_spark(dt: S.DataType, nullable: bool = True) -> Type:
    if isinstance(dt, (S.ByteType, S.ShortType, S.IntegerType, S.LongType)):
        t = INT
    elif isinstance(dt, (S.FloatType, S.DoubleType, S.DecimalType)):
        t = FLOAT
    elif isinstance(dt, S.BooleanType):
        t = BOOLEAN
    elif isinstance(dt, (S.TimestampType, S.TimestampNTZType, S.DateType)):
        t = TIME
    elif isinstance(dt, S.DayTimeIntervalType):
        t = DURATION
    elif isinstance(dt, S.NullType):
        return NULL
    elif isinstance(dt, S.ArrayType):
        t = list_of(from_spark(dt.elementType, dt.containsNull))
    elif isinstance(dt, S.StructType):
        if dt.fields and dt.fields[0].name == TAG:
            t = Type("Union", alts=tuple(from_spark(f.dataType, False) for f in dt.fields[1:]))
        elif dt.fields and [f.name for f in dt.fields] == [f"_{i + 1}" for i in range(len(dt.fields))]:
            t = Type("Tuple", fields=tuple((f.name, from_spark(f.dataType, f.nullable)) for f in dt.fields))
        else:
            t = Type("Struct", fields=tuple((f.name, from_spark(f.dataType, f.nullable)) for f in dt.fields))
    else:
        t = STRING
    return optional(t) if nullable else t


def normal(col: Column, dt: S.DataType) -> Column:
    """A stored column as the dialect's type: integers of 64 bits, doubles, zoned timestamps."""
    if isinstance(dt, (S.ByteType, S.ShortType, S.IntegerType)):
        return col.cast("bigint")
    if isinstance(dt, (S.FloatType, S.DecimalType)):
        return col.cast("double")
    if isinstance(dt, (S.TimestampNTZType, S.DateType)):
        return col.cast("timestamp")
    if isinstance(dt, S.BinaryType):
        return col.cast("string")
    if isinstance(dt, (S.ArrayType, S.StructType)) and dt.simpleString() != to_spark(from_spark(dt)).simpleString():
        return col.cast(to_spark(from_spark(dt)))
    return col


def convert(col: Column, have: Type, want: Type) -> Column:
    """A value of one type in the layout of a wider one."""
    if replace(have, nullable=True) == replace(want, nullable=True):
        return col
    if have.kind == "Null":
        return F.lit(None).cast(to_spark(want))
    if want.kind == "Union":
        def tagged(c: Column, t: Type) -> Column:
            slots = [(convert(c, t, a) if a.kind == t.kind else F.lit(None).cast(to_spark(a))).alias(a.kind) for a in want.alts]
            return F.struct(F.lit(KINDS.index(t.kind)).cast("tinyint").alias(TAG), *slots)

        if have.kind == "Union":
            out = F.lit(None).cast(to_spark(want))
            for a in have.alts:
                out = F.when(col[TAG] == KINDS.index(a.kind), tagged(col[a.kind], a)).otherwise(out)
            return out
        return F.when(col.isNotNull(), tagged(col, required(have)))
    if have.kind == "Int" and want.kind == "Float":
        return col.cast("double")
    if want.kind == "List":
        return F.transform(col, lambda x: convert(x, have.elem or NULL, want.elem)) if want.elem else col
    if want.kind in ("Struct", "Tuple"):
        own = dict(have.fields)
        parts = [(convert(col[n], own[n], t) if n in own else F.lit(None).cast(to_spark(t))).alias(n) for n, t in want.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    return col.cast(to_spark(want))
