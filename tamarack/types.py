"""The dialect's types and their Spark counterparts."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import types as T

from tamarack.errors import BinderError

VECTOR_DIM = "vector_dim"


@dataclass(frozen=True)
class SqlType:
    """A type; ``dim`` is part of VECTOR types, ``spark`` of passed-through ones."""

    name: str
    dim: int = 0
    spark: str = ""

    def __str__(self) -> str:
        return f"VECTOR({self.dim})" if self.name == "VECTOR" else self.spark.upper() if self.name == "OTHER" else self.name

    @property
    def numeric(self) -> bool:
        return self in NUMERIC

    @property
    def data_type(self) -> T.DataType:
        if self.name == "VECTOR":
            return T.ArrayType(T.DoubleType())
        return T.StructType.fromDDL(f"x {self.spark}")[0].dataType if self.name == "OTHER" else _SPARK[self.name]

    def field(self, name: str) -> T.StructField:
        return T.StructField(name, self.data_type, True, {VECTOR_DIM: self.dim} if self.name == "VECTOR" else {})


BOOLEAN, INTEGER, BIGINT, DOUBLE, VARCHAR = map(SqlType, ("BOOLEAN", "INTEGER", "BIGINT", "DOUBLE", "VARCHAR"))
NUMERIC = (INTEGER, BIGINT, DOUBLE)  # in the order of promotion
_SPARK = {"BOOLEAN": T.BooleanType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType()}
#: The spellings of type names.
SPELLINGS = {"boolean": BOOLEAN, "bool": BOOLEAN, "integer": INTEGER, "int": INTEGER, "bigint": BIGINT, "double": DOUBLE, "real": DOUBLE, "varchar": VARCHAR, "text": VARCHAR}


def vector(dim: int) -> SqlType:
    if dim < 1:
        raise BinderError("VECTOR needs a dimension of at least 1")
    return SqlType("VECTOR", dim)


def parse_type(text: str) -> SqlType | None:
    """The type with this spelling, or None."""
    text = text.strip().lower()
    if m := re.fullmatch(r"vector\s*\(\s*(\d+)\s*\)", text):
        return vector(int(m[1]))
    return SPELLINGS.get(text)


def from_field(field: T.StructField, dim: int | None = None) -> SqlType:
    """The type of a DataFrame's column; arrays of numbers are vectors if their dimension is known."""
    for name, data_type in _SPARK.items():
        if field.dataType == data_type:
            return SqlType(name)
    if isinstance(field.dataType, (T.ShortType, T.ByteType)):
        return INTEGER
    if isinstance(field.dataType, T.FloatType):
        return DOUBLE
    dim = dim or (field.metadata or {}).get(VECTOR_DIM)
    if dim and isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, (T.DoubleType, T.FloatType)):
        return vector(int(dim))
    return SqlType("OTHER", spark=field.dataType.simpleString())


def wider(a: SqlType, b: SqlType) -> SqlType:
    return NUMERIC[max(NUMERIC.index(a), NUMERIC.index(b))]


def check_rows(rows: Iterable[tuple], columns: list[tuple[str, SqlType]]) -> list[tuple]:
    """Rows of Python values for a bulk append, by the rules of INSERT; all fit, or nothing is stored."""
    out = []
    for row in map(tuple, rows):
        if len(row) != len(columns):
            raise BinderError(f"{len(columns)} values expected, not {len(row)}")
        out.append(tuple(_fitting(v, name, kind) for v, (name, kind) in zip(row, columns, strict=True)))
    return out


_WIDTH = {INTEGER: 31, BIGINT: 63}


def _fitting(v, name: str, kind: SqlType):
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    if v is None:
        return None
    if kind == DOUBLE and number:
        return float(v)
    if kind in _WIDTH and number and isinstance(v, int) and -(2 ** _WIDTH[kind]) <= v < 2 ** _WIDTH[kind]:
        return v
    if (kind == BOOLEAN and isinstance(v, bool)) or (kind == VARCHAR and isinstance(v, str)):
        return v
    if kind.name == "VECTOR" and isinstance(v, (list, tuple)) and len(v) == kind.dim and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
        return [float(x) for x in v]
    if kind.name == "OTHER":
        try:
            T._make_type_verifier(kind.data_type)(v)
            return v
        except PySparkException:
            pass
    raise BinderError(f"column {name}: {v!r} doesn't fit {kind}")
