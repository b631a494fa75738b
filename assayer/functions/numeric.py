"""Column helpers for numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(c: Column, digits: int) -> Column:
    """Rounds the exact binary value half to even, as IEEE printing does; Spark's own round starts from decimal text."""
    shown = F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits)).cast("double") + F.lit(0.0)
    odd = c.isNull() | F.isnan(c.cast("double")) | F.abs(c.cast("double")).isin(float("inf"))
    return F.when(odd, c.cast("double")).otherwise(shown)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)
