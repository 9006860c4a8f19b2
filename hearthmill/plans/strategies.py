"""Incremental strategies: what a target table is after a batch. Pure functions of two DataFrames.

The result is a plan; :class:`hearthmill.plans.store.TableStore` writes it to a new version. Joins on keys
shuffle the target once; the batch side is broadcast by Spark when its measured size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmill.operators.relational import anti_null_safe, keep_first


class SchemaChange(ValueError):
    """Raised where a batch's columns may not differ from the target's."""


class DuplicateKeys(ValueError):
    """Raised where a merge source holds a key twice."""


def default_strategy(unique_key: list[str] | None) -> str:
    """delete+insert with a key, append without."""
    return "delete_insert" if unique_key else "append"


# --- schema -----------------------------------------------------------------------------------


def schema_diff(target: T.StructType, batch: T.StructType) -> tuple[list[T.StructField], list[str], list[T.StructField]]:
    """(new columns, missing columns, columns of another type)."""
    a, b = {f.name: f for f in target}, {f.name: f for f in batch}
    return [f for f in batch if f.name not in a], [n for n in a if n not in b], [f for n, f in b.items() if n in a and a[n].dataType != f.dataType]


def sync_schema(target: DataFrame, batch: DataFrame, mode: str = "ignore") -> tuple[DataFrame, DataFrame]:
    """Target and batch with the same columns, by ``ignore``, ``fail``, ``append_new_columns`` or ``sync_all_columns``."""
    new, gone, changed = schema_diff(target.schema, batch.schema)
    if mode == "fail" and (new or gone or changed):
        raise SchemaChange(f"new {[f.name for f in new]}, missing {gone}, changed {[f.name for f in changed]}")
    if mode in ("append_new_columns", "sync_all_columns"):
        for f in new:
            target = target.withColumn(f.name, F.lit(None).cast(f.dataType))
    if mode == "sync_all_columns":
        target = target.drop(*gone)
        for f in changed:
            target = target.withColumn(f.name, F.col(f"`{f.name}`").try_cast(f.dataType))
    kinds = {f.name: f.dataType for f in target.schema}
    have = set(batch.columns)
    batch = batch.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])
    return target, batch


# --- strategies -------------------------------------------------------------------------------


def append(target: DataFrame, batch: DataFrame) -> DataFrame:
    """All rows of both."""
    return target.unionByName(batch)


def delete_insert(target: DataFrame, batch: DataFrame, keys: list[str], predicate: Column | None = None) -> DataFrame:
    """Target rows whose key the batch has are replaced by all batch rows of it, repeats included.

    With a predicate only target rows that meet it may be deleted. A null key deletes nothing (a tuple IN).
    """
    doomed = batch.select(*keys).distinct()
    if predicate is None:
        return target.join(doomed, keys, "left_anti").select(*target.columns).unionByName(batch)
    inside = predicate.isNotNull() & predicate
    kept = target.where(~F.coalesce(inside, F.lit(False))).unionByName(target.where(inside).join(doomed, keys, "left_anti").select(*target.columns))
    return kept.unionByName(batch)


def check_unique(df: DataFrame, keys: list[str]) -> None:
    """Error if a key without nulls occurs twice."""
    twice = df.na.drop(subset=keys).groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise DuplicateKeys(f"key occurs more than once: {twice[0].asDict()}")


def merge(target: DataFrame, batch: DataFrame, keys: list[str] | None, update: list[str] | None = None, exclude: list[str] | None = None, checked: bool = True) -> DataFrame:
    """Matched rows take the batch's values, others are inserted; without keys all are inserted.

    ``update``: the columns to take over (all by default), ``exclude``: those not to. Null keys match
    nothing. A key twice in the batch is an error.
    """
    if not keys:
        return append(target, batch)
    if checked:
        check_unique(batch, keys)
    take = set(update if update is not None else target.columns) - set(exclude or [])
    t, b = target.withColumn("__t", F.lit(True)).alias("t"), batch.withColumn("__b", F.lit(True)).alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"t.`{k}`") == F.col(f"b.`{k}`") for k in keys])
    hit = F.col("b.__b").isNotNull()
    out = []
    for c in target.columns:
        old, new = F.col(f"t.`{c}`"), F.col(f"b.`{c}`")
        out.append(F.when(hit & (F.lit(c in take) | F.col("t.__t").isNull()), new).otherwise(old).alias(c))
    return t.join(b, on, "full").select(*out)


def insert_overwrite(target: DataFrame, batch: DataFrame, predicate: Column) -> DataFrame:
    """Target rows that meet the predicate go, the batch comes."""
    return target.where(~F.coalesce(predicate, F.lit(False))).unionByName(batch)


def overwrite_partitions(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Partitions that the batch has rows of are replaced by them; null is a partition."""
    return anti_null_safe(target, batch, keys).unionByName(batch)


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows only: the batch's first row of each key that the target lacks, null equal to null. Returns what to append."""
    first = keep_first(batch, keys, order or [F.lit(0)]) if order else batch.dropDuplicates(keys)
    return anti_null_safe(first, target, keys)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Insert, or update only the listed columns of the row that is there."""
    return merge(target, batch, keys, update=update)


def newer_than(df: DataFrame, column: str, target: DataFrame | None) -> DataFrame:
    """Rows past the target's high-water mark, pushed into the scan as a literal.

    Older, late rows are dropped. Without a target all rows pass; an empty one has no mark,
    the comparison with it is unknown, and nothing passes.
    """
    if target is None:
        return df
    mark = target.agg(F.max(column)).first()[0]
    return df.where(F.lit(False)) if mark is None else df.where(F.col(column) > F.lit(mark))


def microbatch(target: DataFrame, source: DataFrame, event_time: str, periods: list[tuple], keys: list[str]) -> DataFrame:
    """Period after period [start, end): merge its rows on the keys."""
    if not keys:
        raise ValueError("microbatch needs a unique key")
    for start, end in periods:
        target = merge(target, source.where((F.col(event_time) >= F.lit(start)) & (F.col(event_time) < F.lit(end))), keys)
    return target
