"""Syntax tree of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Interval:
    amount: int
    unit: str


@dataclass(frozen=True)
class Name:
    name: str
    qualifier: str | None = None


@dataclass(frozen=True)
class Star:
    qualifier: str | None = None


@dataclass(frozen=True)
class Spread:
    """obj->*"""

    value: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Logic:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Field:
    value: Any
    name: str


@dataclass(frozen=True)
class Assert:
    """value::type"""

    value: Any
    type: str


@dataclass(frozen=True)
class In:
    value: Any
    options: Any
    negated: bool = False


@dataclass(frozen=True)
class Is:
    value: Any
    what: str
    negated: bool = False


@dataclass(frozen=True)
class Case:
    operand: Any
    whens: tuple
    other: Any


@dataclass(frozen=True)
class TupleOf:
    items: tuple


@dataclass(frozen=True)
class Sub:
    query: Any


@dataclass(frozen=True)
class Exists:
    query: Any


@dataclass
class Item:
    value: Any
    alias: str | None = None


@dataclass
class Table:
    name: str
    options: dict[str, str]
    alias: str | None = None


@dataclass
class Derived:
    query: Any
    alias: str


@dataclass
class Function:
    name: str
    args: dict[str, Any]
    alias: str


@dataclass
class TableArg:
    table: Any


@dataclass
class Descriptor:
    name: Name


@dataclass
class Join:
    left: Any
    right: Any
    kind: str
    strategy: str | None = None
    on: Any = None
    using: list[str] | None = None


@dataclass
class Trigger:
    kind: str
    count: int | None = None
    delay: Any = None


@dataclass
class Select:
    items: list[Item]
    source: Any = None
    where: Any = None
    group: list = field(default_factory=list)
    having: Any = None
    triggers: list[Trigger] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple[Any, bool]] = field(default_factory=list)
    limit: Any = None
    offset: Any = None
    ctes: list[tuple[str, Any]] = field(default_factory=list)


@dataclass
class SetOp:
    op: str
    all: bool
    left: Any
    right: Any
    order: list[tuple[Any, bool]] = field(default_factory=list)
    limit: Any = None
    offset: Any = None
    ctes: list[tuple[str, Any]] = field(default_factory=list)
