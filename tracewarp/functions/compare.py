"""Predicates and arithmetic that never raise and never yield null where a plain answer exists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(p: Column) -> Column:
    """A predicate as true or false: null counts as false."""
    return F.coalesce(p, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def scaled(c: Column, k: float) -> Column:
    return c.cast("double") * F.lit(float(k))


def percentile(c: Column, q: float) -> Column:
    """Exact percentile by linear interpolation at rank q * (n - 1)."""
    return F.percentile(c.cast("double"), F.lit(q))
