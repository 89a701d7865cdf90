"""Syntax trees, and how expressions without a name are written as column names."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from tamarack.types import SqlType


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class ColumnRef(Expr):
    name: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Constant(Expr):
    value: Any
    type: SqlType

    def __str__(self) -> str:
        if self.value is None:
            return "NULL"
        if isinstance(self.value, tuple):
            return "[" + ", ".join(map(str, self.value)) + "]"
        return f"'{self.value}'" if isinstance(self.value, str) else str(self.value).lower() if isinstance(self.value, bool) else str(self.value)


@dataclass(frozen=True)
class Star(Expr):
    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Binary(Expr):
    """A comparison, AND, OR or arithmetic; ``<>`` is also spelled ``!=``."""

    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} {self.op.upper()} {self.right})"


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]

    def __str__(self) -> str:
        return f"{self.name.lower()}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    ascending: bool = True


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    join: tuple[str, Expr] | None = None
    where: Expr | None = None
    groups: tuple[Expr, ...] = ()
    orders: tuple[Order, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[tuple[str, SqlType], ...]


@dataclass(frozen=True)
class Insert:
    name: str
    rows: tuple[tuple[Constant, ...], ...] = field(default=())


Statement = Select | CreateTable | Insert
