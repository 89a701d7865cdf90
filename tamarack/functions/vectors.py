"""Distances of embedding vectors, as JVM expressions over ``array<double>`` columns.

NULL vectors give NULL.  Dimensions are checked when a query is bound (``tamarack.plans.binder``);
``of_column`` checks them for use with the DataFrame API.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.errors import BinderError


def literal(values: Sequence[float]) -> Column:
    if not len(values):
        raise BinderError("a vector needs at least one element")
    return F.array(*[F.lit(float(v)) for v in values])


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def l2_distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def negative_inner_product(x: Column, y: Column) -> Column:
    return -dot(x, y)


def cosine_distance(x: Column, y: Column) -> Column:
    """1 - cosine; a zero vector is an error, a NULL one gives NULL."""
    xx, yy = dot(x, x), dot(y, y)
    failed = F.raise_error(F.lit("cosine_distance of a zero vector")).cast("double")
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when((xx == 0) | (yy == 0), failed).otherwise(1 - dot(x, y) / (F.sqrt(xx) * F.sqrt(yy)))


#: Names of the dialect's distance functions.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "l2_distance": l2_distance, "array_distance": l2_distance, "cosine_distance": cosine_distance, "array_cosine_distance": cosine_distance,
    "negative_inner_product": negative_inner_product, "array_negative_inner_product": negative_inner_product,
}


def of_column(name: str, field: T.StructField, query: Sequence[float]) -> Column:
    """The distance between a column with a known dimension and a query vector."""
    dim = (field.metadata or {}).get("vector_dim")
    if dim is not None and dim != len(query):
        raise BinderError(f"{name}: {field.name} has dimension {dim}, the query {len(query)}")
    return DISTANCES[name](F.col(f"`{field.name}`").cast("array<double>"), literal(query))
