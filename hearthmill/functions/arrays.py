"""Array and map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def typed_array(*items: Column, kind: str = "int") -> Column:
    """An array with an element type also when it is empty."""
    return F.array(*items).cast(f"array<{kind}>")


def append(a: Column, item: Column) -> Column:
    return F.array_append(a, item)


def join_arrays(*arrays: Column) -> Column:
    return F.concat(*arrays)


def ordered_keys(positions: Column) -> Column:
    """Keys of a map from key to position, in order of position."""
    entries = F.array_sort(F.transform(F.map_entries(positions), lambda e: F.struct(e["value"], e["key"])))
    return F.transform(entries, lambda e: e["key"])


def label_or_code(labels: Column, code: Column) -> Column:
    """The label of a code, or the code itself where it has none."""
    return F.coalesce(F.element_at(labels, code), code)


def list_aggregate(items: Column, separator: str = ",", limit: int | None = None) -> Column:
    """Text of sorted, collected items (an aggregate): nulls are left out, ``limit`` keeps the first ones."""
    a = F.array_sort(F.collect_list(items))
    return F.array_join(a if limit is None else F.slice(a, 1, limit), separator)
