"""Number expressions: casts that round, guarded division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(c: Column) -> Column:
    """Integer by rounding half away from zero (a plain cast would cut off)."""
    return F.round(c).cast("int")


def safe_cast(c: Column, kind: str) -> Column:
    """Cast in which a bad value becomes null."""
    return c.try_cast(kind)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is zero or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def percent_change(now: Column, before: Column) -> Column:
    """Change from ``before`` to ``now`` in percent; null where there is nothing to compare with."""
    return ratio(now - before, before) * 100


def nth_of_grid(c: Column, steps: int = 100) -> Column:
    """Number of the grid step a coordinate lies in; negatives go down."""
    return F.floor(c.cast("double") * steps).cast("long")
