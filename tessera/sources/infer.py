"""Types of CSV and JSON tables from their first rows."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable

from tessera.errors import QueryError
from tessera.types import BOOLEAN, FLOAT, INT, NULL, STRING, TIME, Type, list_of, type_sum

SAMPLE = 100
TIMESTAMP = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\Z")
BOOLEANS = frozenset("1 t T true TRUE True 0 f F false FALSE False".split())


def of_text(s: str | None) -> Type:
    """The type of a CSV cell: the first that its text fits."""
    if s is None or s == "":
        return NULL
    if re.fullmatch(r"[+-]?\d+", s) and -(2**63) <= int(s) < 2**63:
        return INT
    try:
        if "_" not in s and s.strip() == s:
            float(s)
            return FLOAT
    except ValueError:
        pass
    if s in BOOLEANS:
        return BOOLEAN
    return TIME if TIMESTAMP.match(s) else STRING


def csv_types(names: list[str], rows: Iterable[tuple]) -> dict[str, Type]:
    """Int widens to Float; a column of mixed or no types is String."""
    out: dict[str, Type] = {}
    for row in rows:
        for n, v in zip(names, row, strict=True):
            t = of_text(v)
            have = out.get(n)
            if have is not None and {have.kind, t.kind} == {"Int", "Float"}:
                out[n] = Type("Float", have.nullable or t.nullable)
            else:
                out[n] = t if have is None else type_sum(have, t)
    return {n: Type("String", True) if (t := out.get(n, NULL)).kind in ("Null", "Union") else t for n in names}


def of_json(v: object) -> Type:
    if v is None:
        return NULL
    if isinstance(v, bool):
        return BOOLEAN
    if isinstance(v, (int, float)):
        return FLOAT
    if isinstance(v, str):
        return TIME if TIMESTAMP.match(v) else STRING
    if isinstance(v, list):
        return list_of(functools.reduce(type_sum, map(of_json, v)) if v else None)
    return Type("Struct", fields=tuple((k, of_json(v[k])) for k in sorted(v)))


def json_types(lines: Iterable[str]) -> dict[str, Type]:
    """Fields in the order of their names; one that some rows lack can be NULL."""
    out: dict[str, Type] = {}
    rows = 0
    seen: dict[str, int] = {}
    for k, line in enumerate(lines):
        if not line.strip():
            continue
        try:
            row = json.loads(line)
        except ValueError as e:
            raise QueryError(f"couldn't parse line {k}: {e}") from None
        if not isinstance(row, dict):
            raise QueryError(f"couldn't parse line {k}: expected JSON object, got {line.strip()[:80]!r}")
        rows += 1
        for n, v in row.items():
            t = of_json(v)
            out[n] = type_sum(out[n], t) if n in out else t
            seen[n] = seen.get(n, 0) + 1
    return {n: out[n] if seen[n] == rows else type_sum(out[n], NULL) for n in sorted(out)}


def has_union(t: Type | None) -> bool:
    if t is None:
        return False
    return t.kind == "Union" or has_union(t.elem) or any(has_union(f) for _, f in t.fields)
