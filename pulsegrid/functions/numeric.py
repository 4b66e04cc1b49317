"""Guarded arithmetic: ANSI mode raises on x / 0, where the operators want null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(x: Column, digits: int) -> Column:
    """Rounds half away from zero; the small shift keeps decimal ties on one side whatever the order of summation."""
    return F.round(x + F.lit(1e-9), digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def share(condition: Column) -> Column:
    """Share of rows for which the condition is true; null counts as false."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))).cast("long")
