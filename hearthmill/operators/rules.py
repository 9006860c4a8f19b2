"""Ordered rules as column expressions: pattern lists, bands, regex classes, flags, additive scores.

The first rule that holds wins, so the order of a list is part of its meaning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first condition that is true; ``default`` (value or column) where none is."""
    other = default if isinstance(default, Column) else F.lit(default)
    return reduce(lambda acc, r: F.when(r[0], r[1] if isinstance(r[1], Column) else F.lit(r[1])).otherwise(acc), reversed(rules), other)


def like_rules(c: Column, patterns: list[tuple[str, object]], default: object = None) -> Column:
    """First SQL pattern (``%``, ``_``; case aside) that the text matches."""
    return first_match([(c.ilike(p), v) for p, v in patterns], default)


def regex_rules(c: Column, patterns: list[tuple[str, object]], default: object = None) -> Column:
    """First regular expression found in the text."""
    return first_match([(c.rlike(p), v) for p, v in patterns], default)


def bands(c: Column, edges: list[tuple[float, str]], top: str, inclusive: bool = False, null: str | None = None) -> Column:
    """Name of the band a number falls in: below (or up to) each edge in turn, ``top`` beyond; ``null`` for nulls."""
    rules = [(c <= e if inclusive else c < e, n) for e, n in edges]
    return F.when(c.isNull(), F.lit(null)).otherwise(first_match(rules, top))


def trend(c: Column, steps: list[tuple[float, str]], flat: str) -> Column:
    """Class of a change: for each step, from the largest, above it or below its negative; ``flat`` between and for nulls."""
    rules: list[tuple[Column, object]] = []
    for s, name in sorted(steps, reverse=True):
        rules += [(c > s, f"{name} Up".strip()), (c < -s, f"{name} Down".strip())]
    return first_match(rules, flat)


def in_sets(c: Column, sets: list[tuple[list, object]], default: object = None) -> Column:
    """Value of the first list that holds the item (null is in none)."""
    return first_match([(c.isin(items), v) for items, v in sets], default)


def flag(condition: Column) -> Column:
    """1 where a condition is true, else 0 (also where it is unknown)."""
    return F.when(condition, 1).otherwise(0)


def score(parts: list[tuple[Column, int]]) -> Column:
    """Sum of the points of the conditions that are true."""
    return reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p in parts])


def all_present(*cols: Column) -> Column:
    """Whether no column is null."""
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def scaled_by_unit(value: Column, unit: Column, factors: list[tuple[str, float]]) -> Column:
    """A value times the factor of the first word found in its unit; unscaled where the unit is null or says nothing."""
    return first_match([(F.lower(unit).like(f"%{w}%"), value * f) for w, f in factors], value)
