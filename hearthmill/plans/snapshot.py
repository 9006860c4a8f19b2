"""Slowly changing dimension of type 2: snapshots with ``valid_from`` and ``valid_to``.

``take`` gives the whole snapshot table after one look at the source. The open row of
each key meets the source once, in one full outer join; closed rows pass by untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmill.functions.strings import row_hash

META = ("scd_id", "updated_at", "valid_from", "valid_to", "is_deleted")


def _meta(df: DataFrame, keys: list[str], moment: Column, valid_to: Column, deleted: bool) -> DataFrame:
    return (
        df.withColumn("updated_at", moment)
        .withColumn("scd_id", row_hash(*[F.col(f"`{k}`") for k in keys], F.col("updated_at")))
        .withColumn("valid_from", F.col("updated_at"))
        .withColumn("valid_to", valid_to.cast(df.select(moment.alias("m")).schema["m"].dataType))
        .withColumn("is_deleted", F.lit(deleted))
    )


def first(source: DataFrame, keys: list[str], moment: Column, current_until: Column | None = None) -> DataFrame:
    """The first snapshot: every row valid from its moment on."""
    return _meta(source, keys, moment, current_until if current_until is not None else F.lit(None), False)


def changed_by_time(source_moment: Column, stored_from: Column) -> Column:
    """Timestamp strategy: changed if the source's moment lies after the stored version's start."""
    return stored_from < source_moment


def changed_by_check(columns: list[str], old: str = "o", new: str = "n", added: bool = False) -> Column:
    """Check strategy: changed if any of the columns differs, null-aware; a column just added changes every row."""
    if added:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [~F.col(f"{old}.`{c}`").eqNullSafe(F.col(f"{new}.`{c}`")) for c in columns])


def take(
    snapshot: DataFrame,
    source: DataFrame,
    keys: list[str],
    now: Column,
    updated_at: str | None = None,
    check: list[str] | str | None = None,
    hard_deletes: str = "ignore",
    current_until: Column | None = None,
) -> DataFrame:
    """The snapshot after one more look at the source.

    ``updated_at`` selects the timestamp strategy, ``check`` (column list or ``all``) the check strategy.
    ``hard_deletes``: ``ignore``, ``invalidate`` (close the row of a vanished key) or ``new_record`` (close it and
    open a deletion record; a key that is deleted already stays as it is, and reopens if it returns).
    Source columns that the snapshot lacks are added as null; null keys match nothing.
    """
    if (updated_at is None) == (check is None):
        raise ValueError("give either updated_at or check")
    data = [c for c in source.columns]
    added = [c for c in data if c not in snapshot.columns]
    for c in added:
        snapshot = snapshot.withColumn(c, F.lit(None).cast(source.schema[c].dataType))
    gone = [c for c in snapshot.columns if c not in data and c not in META]
    for c in gone:
        source = source.withColumn(c, F.lit(None).cast(snapshot.schema[c].dataType))
    until = current_until if current_until is not None else F.lit(None)
    kind = snapshot.schema["valid_to"].dataType
    open_now = F.col("valid_to").isNull() if current_until is None else F.col("valid_to").eqNullSafe(current_until.cast(kind))
    old, closed = snapshot.where(open_now), snapshot.where(~open_now)
    on = reduce(lambda a, b: a & b, [F.col(f"o.`{k}`") == F.col(f"n.`{k}`") for k in keys])
    moment = F.col(f"n.`{updated_at}`") if updated_at else now
    columns = data if check == "all" else check
    differs = changed_by_time(F.col(f"n.`{updated_at}`"), F.col("o.valid_from")) if updated_at else changed_by_check([c for c in columns if c not in keys] or list(columns), added=any(c in added for c in columns))
    j = old.withColumn("__o", F.lit(True)).alias("o").join(source.withColumn("__n", F.lit(True)).alias("n"), on, "full")
    there, here = F.col("o.__o").isNotNull(), F.col("n.__n").isNotNull()
    back = F.coalesce(F.col("o.is_deleted"), F.lit(False))
    change = there & here & (F.coalesce(differs, F.lit(False)) | back)
    vanish = there & ~here & ~back & F.lit(hard_deletes != "ignore")
    # which rows each joined pair gives: the old row as it is or closed, a new version, a deletion record
    acts = F.filter(
        F.array(
            F.when(there, F.when(change | vanish, F.lit("close")).otherwise(F.lit("keep"))),
            F.when(here & (~there | change), F.lit("open")),
            F.when(vanish & F.lit(hard_deletes == "new_record"), F.lit("tomb")),
        ),
        lambda x: x.isNotNull(),
    )
    j = j.withColumn("__act", F.explode(acts)).withColumn("__at", F.when(F.col("__act") == "tomb", now.cast(kind)).otherwise(moment.cast(kind)))
    fresh = F.col("__act").isin("open", "tomb")
    body = [F.when(F.col("__act") == "open", F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")).alias(c) for c in snapshot.columns if c not in META]
    ends = F.when(F.col("__act") == "close", F.when(vanish, now.cast(kind)).otherwise(moment.cast(kind))).when(fresh, until.cast(kind)).otherwise(F.col("o.valid_to"))
    key = [F.when(F.col("__act") == "open", F.col(f"n.`{k}`")).otherwise(F.col(f"o.`{k}`")) for k in keys]
    out = j.select(
        *body,
        F.when(fresh, F.col("__at")).otherwise(F.col("o.updated_at")).alias("updated_at"),
        F.when(fresh, row_hash(*key, F.col("__at"), *[F.when(F.col("__act") == "tomb", F.lit("deleted"))])).otherwise(F.col("o.scd_id")).alias("scd_id"),
        F.when(fresh, F.col("__at")).otherwise(F.col("o.valid_from")).alias("valid_from"),
        ends.alias("valid_to"),
        F.when(F.col("__act") == "tomb", F.lit(True)).when(F.col("__act") == "open", F.lit(False)).otherwise(F.col("o.is_deleted")).alias("is_deleted"),
    )
    return closed.unionByName(out)
