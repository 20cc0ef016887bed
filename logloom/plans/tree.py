"""Statements as trees. Nodes compare by structure; places in the text don't count."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from logloom.plans.types import SqlType


@dataclass(frozen=True)
class Node:
    def children(self) -> list[Node]:
        out: list[Node] = []
        for f in fields(self):
            _collect(getattr(self, f.name), out)
        return out


def _collect(value: Any, out: list[Node]) -> None:
    if isinstance(value, Node):
        out.append(value)
    elif isinstance(value, tuple):
        for v in value:
            _collect(v, out)


@dataclass(frozen=True)
class Literal(Node):
    value: Any
    type: SqlType


@dataclass(frozen=True)
class Name(Node):
    name: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Star(Node):
    pass


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Within(Node):
    """[NOT] IN over listed values."""

    operand: Node
    items: tuple[Node, ...]
    negated: bool


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Case(Node):
    branches: tuple[tuple[Node, Node], ...]
    otherwise: Node


@dataclass(frozen=True)
class Cast(Node):
    operand: Node
    type: SqlType


@dataclass(frozen=True)
class Item(Node):
    operand: Node
    index: Node


@dataclass(frozen=True)
class Projection:
    expression: Node
    name: str | None = None


@dataclass(frozen=True)
class Join:
    table: str
    path: str
    left: Name
    right: Name
    outer: bool


@dataclass(frozen=True)
class Select:
    projections: tuple[Projection, ...]
    table: str
    path: str | None = None
    where: Node | None = None
    group_by: tuple[Node, ...] | None = None
    having: Node | None = None
    join: Join | None = None
    limit: int | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Reference:
    """A group of a pattern's match, or a part of a split; 0 is the whole."""

    pattern: str
    group: int


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: SqlType
    references: tuple[Reference, ...] = ()
    path: tuple[str | int, ...] = ()
    not_null: bool = False
    trim: bool = False
    convert: bool = False
    microseconds: bool = False
    default: Any = None


@dataclass(frozen=True)
class PatternDef:
    name: str
    regex: str
    split: bool = False


@dataclass(frozen=True)
class TableDef:
    name: str
    patterns: tuple[PatternDef, ...] = field(default=())
    columns: tuple[ColumnDef, ...] = field(default=())

    def pattern(self, name: str) -> PatternDef | None:
        return next((p for p in reversed(self.patterns) if p.name == name), None)


Statement = Select | TableDef | tuple[TableDef, ...]
