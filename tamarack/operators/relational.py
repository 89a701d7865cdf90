"""The operators as functions on DataFrames; Catalyst plans and runs them.

Filters and pruned columns reach the Parquet scan, aggregates run in two phases, the join algorithm and
its build side are Spark's choice by size (nothing is broadcast by hint), and ordering with a limit becomes
one top-k step that never sorts the whole input.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Spark's limits are 32-bit.
MOST_ROWS = 2**31 - 1


def scan(source: SparkSession | DataFrame, path: str | None = None, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """A table's rows; the predicate sees all columns, the result has ``columns``."""
    df = source.read.parquet(path) if isinstance(source, SparkSession) else source
    df = df if where is None else df.filter(where)
    return df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true, not NULL."""
    return df.filter(predicate)


def project(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(*columns)


def aggregate(df: DataFrame, groups: Sequence[Column], aggregates: Sequence[Column]) -> DataFrame:
    """Keys, then aggregates; without keys exactly one row."""
    return df.groupBy(*groups).agg(*aggregates) if groups else df.agg(*aggregates)


def join_inner(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Columns of the left side, then of the right; NULL keys match nothing."""
    return left.join(right, on, "inner")


def sort_key(column: Column | str, ascending: bool = True) -> Column:
    """NULL is the least value."""
    c = F.col(column) if isinstance(column, str) else column
    return c.asc_nulls_first() if ascending else c.desc_nulls_last()


def order_by(df: DataFrame, *keys: tuple[Column | str, bool]) -> DataFrame:
    return df.orderBy(*[sort_key(c, up) for c, up in keys])


def limit(df: DataFrame, n: int) -> DataFrame:
    """The first n rows.  Beyond Spark's own bound the rows are written once and counted by partition, whose order
    is that of the rows, so a limit of 64 bits holds too."""
    if n <= MOST_ROWS:
        return df.limit(n)
    if df.count() <= n:
        return df
    whole = df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()
    left, last = n, None
    for part, rows in sorted(map(tuple, whole.groupBy(F.spark_partition_id().alias("p")).count().collect())):
        last = (part << 33) + min(rows, left)
        if (left := left - rows) <= 0:
            break
    return whole.filter(F.monotonically_increasing_id() < last)


def top_k(df: DataFrame, k: int, *keys: tuple[Column | str, bool]) -> DataFrame:
    return limit(order_by(df, *keys), k)


def collect(df: DataFrame) -> list[Row]:
    return df.collect()


def stream_rows(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time, for results that don't fit on the driver at once."""
    return df.toLocalIterator(prefetchPartitions=True)
