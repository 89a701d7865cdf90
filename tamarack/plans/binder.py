"""Syntax trees to DataFrames: names, strict types, aggregates, and the order of the operators.

The plan is scan or join, filter, aggregate, projection, order, limit, all declared with the DataFrame
API, so Catalyst prunes columns, pushes filters into scans and through joins, and picks the algorithms.
Types are carried beside the columns, because Spark would convert at run time what the dialect refuses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.errors import BinderError
from tamarack.functions import expressions as ex
from tamarack.functions import vectors
from tamarack.operators import relational as ops
from tamarack.plans.syntax import Binary, Call, ColumnRef, Constant, Expr, Insert, Item, Select, Star
from tamarack.types import BIGINT, BOOLEAN, DOUBLE, INTEGER, VECTOR_DIM, SqlType, wider

AGGREGATES = ("count", "sum", "avg", "min", "max")
_COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Bound:
    """A column expression with its type; ``fixed``: it is a constant.  Any other double may be NaN."""

    column: Column
    type: SqlType
    fixed: bool = False

    @property
    def nan(self) -> bool:
        return self.type == DOUBLE and not self.fixed


@dataclass
class Scope:
    """What names mean: (table, column, type, column of the frame), in the order of the tables."""

    columns: list[tuple[str, str, SqlType, str]] = field(default_factory=list)

    def resolve(self, ref: ColumnRef) -> tuple[str, str, SqlType, str]:
        name, table = ref.name.lower(), ref.table.lower() if ref.table else None
        found = [c for c in self.columns if c[1] == name and table in (None, c[0])]
        if not found:
            raise BinderError(f"unknown column {ref}")
        if len(found) > 1:
            raise BinderError(f"column {ref} is ambiguous")
        return found[0]

    def knows(self, ref: ColumnRef) -> bool:
        return any(c[1] == ref.name.lower() and ref.table in (None, c[0]) for c in self.columns)

    def canon(self, expr: Expr) -> tuple:
        """A form in which expressions are equal if they mean the same columns and operations."""
        if isinstance(expr, ColumnRef):
            return ("column", self.resolve(expr)[3])
        if isinstance(expr, Binary):
            return (expr.op, self.canon(expr.left), self.canon(expr.right))
        if isinstance(expr, Call):
            return ("call", expr.name.lower(), *map(self.canon, expr.args))
        return ("constant", repr(expr))


def _constant(c: Constant) -> Bound:
    if c.type.name == "VECTOR":
        return Bound(vectors.literal(c.value), c.type, True)
    return Bound(F.lit(c.value).cast(c.type.data_type), c.type, True)


def _compare(op: str, left: Bound, right: Bound, nulls: bool) -> Bound:
    if nulls:
        return Bound(F.lit(None).cast("boolean"), BOOLEAN)
    if left.type == right.type or left.type.numeric and right.type.numeric:
        return Bound(ex.compare(op, left.column, right.column, right.nan, left.fixed), BOOLEAN)
    if op in ("=", "<>"):
        return Bound(ex.unlike(op, left.column, right.column), BOOLEAN)
    raise BinderError(f"can't order {left.type} and {right.type}")


def _binary(op: str, left: Bound, right: Bound, plain: bool, nulls: bool) -> Bound:
    if op in ("and", "or"):
        if BOOLEAN != left.type or BOOLEAN != right.type:
            raise BinderError(f"{op.upper()} needs booleans, not {left.type} and {right.type}")
        if plain:
            return Bound(left.column & right.column if op == "and" else left.column | right.column, BOOLEAN)
        return Bound((ex.and_ if op == "and" else ex.or_)(left.column, right.column), BOOLEAN)
    if op in _COMPARISONS:
        return _compare(op, left, right, nulls)
    if not (left.type.numeric and right.type.numeric):
        raise BinderError(f"{op} needs numbers, not {left.type} and {right.type}")
    if op == "/":
        return Bound(ex.divide(left.column, right.column), DOUBLE)
    kind = wider(left.type, right.type)
    a, b = left.column.cast(kind.data_type), right.column.cast(kind.data_type)
    return Bound(a + b if op == "+" else a - b if op == "-" else a * b, kind)


def _null(expr: Expr) -> bool:
    return isinstance(expr, Constant) and expr.value is None


def _distance(call: Call, args: list[Bound]) -> Bound:
    name = call.name.lower()
    if len(args) != 2:
        raise BinderError(f"{name} takes two vectors")
    a, b = args
    if a.type.name != "VECTOR" or b.type.name != "VECTOR":
        raise BinderError(f"{name} takes vectors, not {a.type} and {b.type}")
    if a.type.dim != b.type.dim:
        raise BinderError(f"{name}: dimensions {a.type.dim} and {b.type.dim} differ")
    return Bound(vectors.DISTANCES[name](a.column, b.column), DOUBLE)


def is_aggregate(expr: Expr) -> bool:
    return isinstance(expr, Call) and expr.name.lower() in AGGREGATES


def has_aggregate(expr: Expr) -> bool:
    if isinstance(expr, Binary):
        return has_aggregate(expr.left) or has_aggregate(expr.right)
    return isinstance(expr, Call) and (is_aggregate(expr) or any(map(has_aggregate, expr.args)))


def bind(expr: Expr, scope: Scope, plain: bool = False, leaf: Callable[[Expr], Bound | None] = lambda e: None) -> Bound:
    """``plain``: at the root of a filter, where AND and OR may be Spark's own, which scans take over.
    ``leaf`` may give the meaning of an expression as a whole."""
    if (found := leaf(expr)) is not None:
        return found
    if isinstance(expr, Constant):
        return _constant(expr)
    if isinstance(expr, ColumnRef):
        _, _, kind, name = scope.resolve(expr)
        return Bound(F.col(name), kind)
    if isinstance(expr, Binary):
        plain = plain and expr.op in ("and", "or")
        left, right = (bind(e, scope, plain, leaf) for e in (expr.left, expr.right))
        return _binary(expr.op, left, right, plain, _null(expr.left) or _null(expr.right))
    if isinstance(expr, Call):
        if is_aggregate(expr):
            raise BinderError(f"aggregate {expr} isn't allowed here")
        if expr.name.lower() not in vectors.DISTANCES:
            raise BinderError(f"unknown function {expr.name}")
        return _distance(expr, [bind(a, scope, False, leaf) for a in expr.args])
    raise BinderError(f"{expr} isn't allowed here")


def bind_aggregate(call: Call, scope: Scope) -> Bound:
    name = call.name.lower()
    if len(call.args) != 1:
        raise BinderError(f"{name} takes one argument")
    arg = call.args[0]
    if isinstance(arg, Star):
        if name != "count":
            raise BinderError(f"{name}(*) isn't defined")
        return Bound(F.count(F.lit(1)), BIGINT)
    if has_aggregate(arg):
        raise BinderError(f"nested aggregate in {call}")
    x = bind(arg, scope)
    if name == "count":
        return Bound(F.count(x.column), BIGINT)
    if name in ("min", "max"):
        return Bound((F.min if name == "min" else F.max)(x.column), x.type)
    if not x.type.numeric:
        raise BinderError(f"{name} needs numbers, not {x.type}")
    if name == "avg":
        return Bound(F.avg(x.column), DOUBLE)
    return Bound(F.sum(x.column), DOUBLE if x.type == DOUBLE else BIGINT)


def _frame(df: DataFrame, table: str, columns: list[tuple[str, SqlType]], scope: Scope) -> DataFrame:
    """The table's columns under names that are unique in the query."""
    picked = []
    for name, kind in columns:
        own = f"c{len(scope.columns)}"
        picked.append(F.col(f"`{name}`").alias(own))
        scope.columns.append((table.lower(), name.lower(), kind, own))
    return df.select(*picked)


def _conjuncts(expr: Expr) -> list[Expr]:
    return _conjuncts(expr.left) + _conjuncts(expr.right) if isinstance(expr, Binary) and expr.op == "and" else [expr]


def _columns_of(expr: Expr, scope: Scope) -> set[str]:
    if isinstance(expr, ColumnRef):
        return {scope.resolve(expr)[3]}
    parts = (expr.left, expr.right) if isinstance(expr, Binary) else expr.args if isinstance(expr, Call) else ()
    return set().union(*(_columns_of(p, scope) for p in parts))


def _join_condition(on: Expr, left: Scope, both: Scope) -> Column:
    """Equalities between the sides, in either order; keys whose types never match join nothing."""
    mine = {c[3] for c in left.columns}
    out: Column | None = None
    for part in _conjuncts(on):
        if not (isinstance(part, Binary) and part.op == "="):
            raise BinderError(f"a join needs equalities, not {part}")
        a, b = (_columns_of(e, both) for e in (part.left, part.right))
        if not (a and b and (a <= mine and not b & mine or b <= mine and not a & mine)):
            raise BinderError(f"{part} doesn't compare one side of the join with the other")
        x, y = bind(part.left, both), bind(part.right, both)
        same = x.column == y.column if x.type == y.type or x.type.numeric and y.type.numeric else F.lit(False)
        same = same & ~F.isnan(x.column) if x.nan and y.nan else same
        out = same if out is None else out & same
    return out


def _name_of(expr: Expr, scope: Scope) -> str:
    if isinstance(expr, ColumnRef):
        table, column, _, _ = scope.resolve(expr)
        return f"{table}.{column}"
    return str(expr)


def bind_select(stmt: Select, lookup: Callable[[str], tuple[DataFrame, list[tuple[str, SqlType]]]]) -> DataFrame:
    scope = Scope()
    df = _frame(*_table(stmt.table, lookup), scope)
    if stmt.join:
        other, on = stmt.join
        if other.lower() == stmt.table.lower():
            raise BinderError("a table can't be joined with itself")
        left = Scope(list(scope.columns))
        right = _frame(*_table(other, lookup), scope)
        df = ops.join_inner(df, right, _join_condition(on, left, scope))
    if stmt.where is not None:
        where = bind(stmt.where, scope, plain=True)
        if where.type != BOOLEAN:
            raise BinderError(f"WHERE needs a boolean, not {where.type}")
        df = ops.filter_rows(df, where.column)

    items = [i for item in stmt.items for i in ([Item(ColumnRef(c[1], c[0])) for c in scope.columns] if isinstance(item.expr, Star) else [item])]
    grouped = bool(stmt.groups) or any(has_aggregate(i.expr) for i in items)
    if grouped and any(isinstance(i.expr, Star) for i in stmt.items):
        raise BinderError("SELECT * can't be grouped")
    if grouped:
        df, bounds = _aggregate(df, stmt, items, scope)
    else:
        bounds = [bind(i.expr, scope) for i in items]
    names = [i.alias or _name_of(i.expr, scope) for i in items]
    df = ops.project(df, *[_named(b, f"o{k}") for k, b in enumerate(bounds)])
    if stmt.orders:
        df = ops.order_by(df, *[(f"o{_output(o.expr, items, scope)}", o.ascending) for o in stmt.orders])
    if stmt.limit is not None:
        df = ops.limit(df, stmt.limit)
    return df.toDF(*names)


def _named(b: Bound, name: str) -> Column:
    return b.column.alias(name, metadata={VECTOR_DIM: b.type.dim}) if b.type.name == "VECTOR" else b.column.alias(name)


def _table(name: str, lookup: Callable) -> tuple[DataFrame, str, list[tuple[str, SqlType]]]:
    df, columns = lookup(name)
    return df, name, columns


def _ordinal(expr: Expr, items: list[Item]) -> int | None:
    if isinstance(expr, Constant) and expr.type == INTEGER and expr.value is not None:
        if not 1 <= expr.value <= len(items):
            raise BinderError(f"position {expr.value} isn't in the select list")
        return expr.value - 1
    return None


def _output(expr: Expr, items: list[Item], scope: Scope) -> int:
    """Which select item an ORDER BY key is: by position, alias or meaning."""
    if (k := _ordinal(expr, items)) is not None:
        return k
    if isinstance(expr, ColumnRef) and expr.table is None:
        for k, i in enumerate(items):
            if i.alias and i.alias.lower() == expr.name.lower():
                return k
    want = scope.canon(expr)
    for k, i in enumerate(items):
        if scope.canon(i.expr) == want:
            return k
    raise BinderError(f"ORDER BY {expr} isn't in the select list")


def _aggregate(df: DataFrame, stmt: Select, items: list[Item], scope: Scope) -> tuple[DataFrame, list[Bound]]:
    """The aggregated frame, and the select list over its keys and aggregates."""
    keys: dict[tuple, Bound] = {}
    columns: list[Column] = []
    for g in stmt.groups:
        if (k := _ordinal(g, items)) is not None:
            g = items[k].expr
        elif isinstance(g, ColumnRef) and not scope.knows(g):
            g = next((i.expr for i in items if i.alias and i.alias.lower() == g.name.lower() and g.table is None), g)
        if has_aggregate(g):
            raise BinderError("aggregates can't be grouped by")
        b, name = bind(g, scope), f"g{len(columns)}"
        columns.append(_named(b, name))
        keys.setdefault(scope.canon(g), Bound(F.col(name), b.type))
    found: dict[tuple, tuple[Column, Bound]] = {}

    def leaf(expr: Expr) -> Bound | None:
        if isinstance(expr, (Constant, Star)):
            return None
        if (key := keys.get(scope.canon(expr) if not isinstance(expr, Call) or not is_aggregate(expr) else ())) is not None:
            return key
        if is_aggregate(expr):
            what = ("call", expr.name.lower(), *(("star",) if isinstance(a, Star) else scope.canon(a) for a in expr.args))
            if what not in found:
                b, name = bind_aggregate(expr, scope), f"a{len(found)}"
                found[what] = (b.column.alias(name), Bound(F.col(name), b.type))
            return found[what][1]
        if isinstance(expr, ColumnRef):
            raise BinderError(f"{expr} must be grouped by or aggregated")
        return None

    bounds = [bind(i.expr, scope, False, leaf) for i in items]
    if found or columns:
        made = [c for c, _ in found.values()]
        df = ops.aggregate(df, columns, made) if made else df.select(*columns).distinct()
    return df, bounds


def check_insert(stmt: Insert, columns: list[tuple[str, SqlType]]) -> list[tuple]:
    """The rows of an INSERT as values of the columns' types; nothing is stored unless all fit."""
    out = []
    for row in stmt.rows:
        if len(row) != len(columns):
            raise BinderError(f"{len(columns)} values expected, not {len(row)}")
        out.append(tuple(_stored(c, name, kind) for c, (name, kind) in zip(row, columns, strict=True)))
    return out


def _stored(c: Constant, name: str, kind: SqlType):
    if c.value is None:
        return None
    if c.type == kind:
        return [float(v) for v in c.value] if kind.name == "VECTOR" else c.value
    if kind == DOUBLE and c.type.numeric:
        return float(c.value)
    if kind == BIGINT and c.type == INTEGER:
        return c.value
    raise BinderError(f"column {name}: {c.type} doesn't fit {kind}")
