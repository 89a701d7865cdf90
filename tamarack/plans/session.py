"""A catalog of tables and the statements over it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack import types
from tamarack.errors import BinderError, CatalogError, ExecutionError
from tamarack.plans import binder
from tamarack.plans.parser import parse
from tamarack.plans.syntax import CreateTable, Insert, Select


class Table:
    """A fixed schema, and frames and literal rows that were appended."""

    def __init__(self, spark: SparkSession, columns: list[tuple[str, types.SqlType]], frame: DataFrame | None = None) -> None:
        self.spark, self.columns, self.frames, self.rows = spark, columns, [frame] if frame is not None else [], []

    @property
    def schema(self) -> T.StructType:
        return T.StructType([kind.field(name) for name, kind in self.columns])

    def df(self) -> DataFrame:
        own = [self.spark.createDataFrame(self.rows, self.schema)] if self.rows or not self.frames else []
        return reduce(DataFrame.unionByName, self.frames + own)


class Session:
    """Statements of the dialect; names have any case.

    SELECT gives a lazy DataFrame, CREATE TABLE and INSERT one row ``ok = 'OK'``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._tables: dict[str, Table] = {}
        self._files: dict[str, tuple[str, Mapping[str, int] | None]] = {}

    # -- catalog

    def tables(self) -> list[str]:
        return sorted({*self._tables, *self._files})

    def exists(self, name: str) -> bool:
        return name.lower() in self._tables or name.lower() in self._files

    def table(self, name: str) -> Table:
        if not self.exists(name):
            raise CatalogError(f"table {name} doesn't exist")
        if (file := self._files.pop(name.lower(), None)) is not None:
            self.register(name, self.spark.read.parquet(file[0]), file[1])
        return self._tables[name.lower()]

    def register(self, name: str, df: DataFrame, vector_dims: Mapping[str, int] | None = None) -> None:
        """Makes a DataFrame a table.  ``vector_dims`` gives dimensions of array columns without metadata."""
        if self.exists(name):
            raise CatalogError(f"table {name} exists")
        dims = {k.lower(): v for k, v in (vector_dims or {}).items()}
        columns = [(f.name.lower(), types.from_field(f, dims.get(f.name.lower()))) for f in df.schema]
        if len({c for c, _ in columns}) < len(columns):
            raise BinderError(f"table {name} repeats a column name")
        cast = [F.col(f"`{f.name}`").alias(c) if f.dataType == kind.data_type else F.col(f"`{f.name}`").cast(kind.data_type).alias(c) for f, (c, kind) in zip(df.schema, columns, strict=True)]
        self._tables[name.lower()] = Table(self.spark, columns, df.select(*cast))

    def register_parquet(self, name: str, path: str, vector_dims: Mapping[str, int] | None = None) -> None:
        """Makes Parquet a table; its files are looked at when a statement first names it."""
        if self.exists(name):
            raise CatalogError(f"table {name} exists")
        self._files[name.lower()] = (path, vector_dims)

    def create(self, name: str, columns: Iterable[tuple[str, types.SqlType]]) -> None:
        columns = [(c.lower(), kind) for c, kind in columns]
        if self.exists(name):
            raise CatalogError(f"table {name} exists")
        if not columns:
            raise BinderError("a table needs a column")
        if len({c for c, _ in columns}) < len(columns):
            raise BinderError(f"table {name} repeats a column name")
        self._tables[name.lower()] = Table(self.spark, columns)

    def append(self, name: str, data: DataFrame | Iterable[tuple]) -> None:
        """Bulk append; columns by position, their types as declared."""
        t = self.table(name)
        if isinstance(data, DataFrame):
            dims = [(f.metadata or {}).get(types.VECTOR_DIM, kind.dim) for f, (_, kind) in zip(data.schema, t.columns)]
            if [f.dataType.simpleString() for f in data.schema] != [f.dataType.simpleString() for f in t.schema] or dims != [kind.dim for _, kind in t.columns]:
                raise BinderError(f"table {name}: columns or types differ")
            t.frames.append(data.toDF(*[c for c, _ in t.columns]))
        else:
            t.rows += types.check_rows(data, t.columns)

    # -- statements

    def query(self, sql: str) -> DataFrame:
        stmt = parse(sql)
        if isinstance(stmt, Select):
            try:
                return binder.bind_select(stmt, lambda name: ((t := self.table(name)).df(), t.columns))
            except AnalysisException as e:
                raise BinderError(str(e)) from e
        if isinstance(stmt, CreateTable):
            self.create(stmt.name, stmt.columns)
        if isinstance(stmt, Insert):
            t = self.table(stmt.name)
            t.rows += binder.check_insert(stmt, t.columns)
        return self.spark.createDataFrame([("OK",)], "ok string")

    def fetch(self, sql: str) -> list[Row]:
        """All rows of a statement on the driver; failures while it runs are ExecutionErrors."""
        df = self.query(sql)
        try:
            return df.collect()
        except PySparkException as e:
            raise ExecutionError(str(e)) from e
        except Exception as e:
            if type(e).__module__.startswith("py4j"):
                raise ExecutionError(str(e)) from e
            raise
