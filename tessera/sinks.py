"""Outputs: the table, CSV, JSON and change-stream forms of a result, its description and its plan."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import math
from collections.abc import Iterable, Iterator
from decimal import Decimal

from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.plans import ast as A
from tessera.session import Query
from tessera.types import KINDS, TAG, Type


def number(x: float) -> str:
    """The shortest digits; a table or JSON shows large and small ones with an exponent."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "+Inf" if x > 0 else "-Inf"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    return repr(x)


def general(x: float) -> str:
    """As number(), but with an exponent from a million on and below 1e-4."""
    if math.isnan(x) or math.isinf(x) or x == 0:
        return number(x)
    sign, figures, exponent = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, figures)).rstrip("0")
    power = len(figures) + exponent - 1
    if -4 <= power < 6:
        return number(x)
    return f"{'-' if sign else ''}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{power:+03d}"


def duration(d: dt.timedelta) -> str:
    """5h32m42s, with fractions of a second as they are."""
    us = d // dt.timedelta(microseconds=1)
    sign, us = ("-", -us) if us < 0 else ("", us)
    if us == 0:
        return "0s"
    if us < 1000:
        return f"{sign}{us}µs"
    if us < 1_000_000:
        return f"{sign}{number(us / 1000)}ms"
    h, us = divmod(us, 3_600_000_000)
    m, us = divmod(us, 60_000_000)
    seconds = f"{us // 1_000_000}" + (f".{us % 1_000_000:06d}".rstrip("0") if us % 1_000_000 else "")
    return f"{sign}{f'{h}h' if h else ''}{f'{m}m' if h or m else ''}{seconds}s"


def instant(t: dt.datetime) -> str:
    t = t if t.tzinfo is None else t.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return t.strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0") + (f".{t.microsecond:06d}".rstrip("0") if t.microsecond else "") + "Z"


def chosen(v: Row, t: Type) -> tuple[object, Type]:
    """The value and type of a union's alternative."""
    kind = KINDS[v[TAG]]
    return v[kind], next(a for a in t.alts if a.kind == kind)


def shown(v: object, t: Type) -> str:
    """As a table shows it."""
    if v is None or t.kind == "Null":
        return "<null>"
    if t.kind == "Union":
        return shown(*chosen(v, t))
    if t.kind == "Float":
        return general(v)
    if t.kind == "Boolean":
        return "true" if v else "false"
    if t.kind == "String":
        return f"'{v}'"
    if t.kind == "Time":
        return instant(v)
    if t.kind == "Duration":
        return duration(v)
    if t.kind == "List":
        return "[" + ", ".join(shown(x, t.elem) for x in v) + "]"
    if t.kind in ("Struct", "Tuple"):
        inner = ", ".join(shown(x, f) for x, (_, f) in zip(v, t.fields, strict=True))
        return f"{{ {inner} }}" if t.kind == "Struct" else f"({inner})"
    return str(v)


def plain(v: object, t: Type) -> object:
    """As JSON has it."""
    if v is None or t.kind == "Null":
        return None
    if t.kind == "Union":
        return plain(*chosen(v, t))
    if t.kind == "Float":
        return None if math.isnan(v) or math.isinf(v) else int(v) if v == int(v) and abs(v) < 1e21 else v
    if t.kind == "Time":
        return instant(v)
    if t.kind == "Duration":
        return duration(v)
    if t.kind == "List":
        return [plain(x, t.elem) for x in v]
    if t.kind == "Struct":
        return {n: plain(x, f) for x, (n, f) in zip(v, t.fields, strict=True)}
    if t.kind == "Tuple":
        return [plain(x, f) for x, (_, f) in zip(v, t.fields, strict=True)]
    return v


def table_text(names: list[str], rows: Iterable[list[str]], right: list[bool]) -> str:
    rows = list(rows)
    width = [max([len(n), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
    line = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    out = [line, "|" + "|".join(f" {n.center(w)} " for n, w in zip(names, width, strict=True)) + "|", line]
    for r in rows:
        out.append("|" + "|".join(f" {c.rjust(w) if a else c.ljust(w)} " for c, w, a in zip(r, width, right, strict=True)) + "|")
    return "\n".join([*out, line]) + "\n"


def batch_table(q: Query) -> str:
    """The final rows, sorted by the query's order and then by all values."""
    ordered = isinstance(q.tree, (A.Select, A.SetOp)) and (q.tree.order or q.tree.limit is not None)
    rows = (q.frame if ordered else q.frame.orderBy(*[F.col(f"`{n}`").asc_nulls_first() for n, _ in q.columns])).collect()
    right = [t.kind in ("Int", "Float") for _, t in q.columns]
    return table_text([n for n, _ in q.columns], [[shown(v, t) for v, (_, t) in zip(r, q.columns, strict=True)] for r in rows], right)


def csv_rows(columns: list[tuple[str, Type]], rows: Iterable[Row], header: bool = True) -> Iterator[str]:
    def line(cells: list[str]) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(cells)
        return out.getvalue()

    if header:
        yield line([n for n, _ in columns])
    for r in rows:
        cells = []
        for v, (n, t) in zip(r, columns, strict=True):
            v, t = chosen(v, t) if t.kind == "Union" and v is not None else (v, t)
            if t.kind in ("List", "Struct", "Tuple") and v is not None:
                raise ValueError(f"column {n}: a {t.kind} can't be written as CSV")
            cells.append("" if v is None else v if t.kind == "String" else number(v) if t.kind == "Float" else shown(v, t))
        yield line(cells)


def csv_lines(q: Query) -> Iterator[str]:
    return csv_rows(q.columns, q.frame.toLocalIterator())


def json_rows(columns: list[tuple[str, Type]], rows: Iterable[Row]) -> Iterator[str]:
    for r in rows:
        yield json.dumps({n: plain(v, t) for v, (n, t) in zip(r, columns, strict=True)}, ensure_ascii=False, separators=(",", ":")) + "\n"


def json_lines(q: Query) -> Iterator[str]:
    return json_rows(q.columns, q.frame.toLocalIterator())


def stream_line(q: Query, r: Row) -> str:
    time = q.time_field
    at = instant(r[time]) if time and r[time] is not None else "0001-01-01T00:00:00Z"
    values = ", ".join(shown(r[n], t) for n, t in q.columns)
    return f"{{{'-' if r['__retraction'] else '+'}{at}| {values} |}}\n"


def stream_lines(q: Query) -> Iterator[str]:
    """{+time| values |} for records, {-...} for their retractions."""
    log = q.changelog()
    ordered = log.orderBy("__at", "__step") if q.relation.emission else log
    return (stream_line(q, r) for r in ordered.toLocalIterator())


def describe(q: Query) -> list[tuple[str, str, bool]]:
    return [(n, str(t), n == q.time_field) for n, t in q.columns]


def explain(q: Query, level: int = 1) -> str:
    """Spark's plan: 1 the physical one, 2 all with types."""
    return q.frame._jdf.queryExecution().explainString(q.frame._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted" if level == 1 else "extended"))


def write(q: Query, kind: str, path: str) -> None:
    """The result to files, by Spark's distributed writers."""
    if kind == "csv":
        q.frame.write.option("header", True).csv(path)
    elif kind == "json":
        q.frame.write.option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        q.frame.write.parquet(path)
    else:
        raise ValueError(f"unknown output {kind}")
