"""Column expressions where the dialect differs from Spark's defaults.

Comparison and arithmetic with NULL give NULL.  AND and OR take NULL for false.  Division is always
of doubles and gives NaN for a zero divisor.  NaN is unequal to, and above, everything: ``=``, ``<`` and
``<=`` with it are false, the others true.  Spark has this for a NaN on the left beside a number, so only a
right side that may be NaN needs more than Spark's own comparison, which scans take over.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def and_(left: Column, right: Column) -> Column:
    """AND whose value is never NULL."""
    return F.coalesce(left, F.lit(False)) & F.coalesce(right, F.lit(False))


def or_(left: Column, right: Column) -> Column:
    """OR whose value is never NULL."""
    return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))


def divide(left: Column, right: Column) -> Column:
    left, right = left.cast("double"), right.cast("double")
    return F.when(left.isNull() | right.isNull(), F.lit(None).cast("double")).when(right == 0, F.lit(NAN)).otherwise(left / right)


def compare(op: str, left: Column, right: Column, nan: bool = False, fixed: bool = False) -> Column:
    """``nan``: the right side may be NaN; ``fixed``: the left side is a constant, so never NULL."""
    plain = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    if not nan:
        return plain
    above, none = op in ("<>", ">", ">="), F.isnan(right.cast("double"))
    if fixed:
        return plain | none if above else plain & ~none
    return F.when(none, F.when(left.isNotNull(), F.lit(above))).otherwise(plain)


def unlike(op: str, left: Column, right: Column) -> Column:
    """Equality of values whose types never match: false (``<>``: true), NULL with NULL."""
    return F.when(left.isNotNull() & right.isNotNull(), F.lit(op == "<>"))
