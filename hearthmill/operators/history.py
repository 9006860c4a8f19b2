"""Full history of changing attributes from periodic snapshots or updates.

Storage is checkpoint and delta: for each entity, a full version at the start
of every chunk of its time line and at every ``every``-th stored row in it (a
checkpoint) and, for each later change in the chunk, a patch that holds only the
attributes that changed. Validity rows
come from folding patches forward from the nearest checkpoint.

An entity's rows are never brought to one task as a whole: an entity with more
rows than ``chunk_rows`` is cut into chunks of that many rows in order of time, and only one row for each
chunk (its checkpoint and final state) meets the other chunks of the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthmill.operators.relational import numbered, small
from hearthmill.session import materialize


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def observed(df: DataFrame, entity: str, at: str, order: str, attributes: list[str]) -> DataFrame:
    """What each entity was seen to be at each moment: (entity, at, opening, state).

    Of several rows of one entity and moment the one with the largest ``order``
    counts. Rows with a null entity or moment, or with all attributes null, say nothing.
    """
    state = F.struct(*[F.col(f"`{a}`").alias(a) for a in attributes])
    known = F.coalesce(*[F.col(f"`{a}`").isNotNull() | F.lit(False) for a in attributes][:1])
    for a in attributes[1:]:
        known = known | F.col(f"`{a}`").isNotNull()
    return (
        df.where(F.col(entity).isNotNull() & F.col(at).isNotNull() & known)
        .groupBy(F.col(entity).alias("entity"), F.col(at).alias("at"))
        .agg(F.max(F.struct(F.col(order).alias("opening"), state.alias("state"))).alias("x"))
        .select("entity", "at", "x.opening", "x.state")
    )


def chunked(seen: DataFrame, chunk_rows: int = 100_000) -> DataFrame:
    """``seen`` with ``chunk``: 0 for most entities; for those above ``chunk_rows`` rows, a number that grows with time.

    Chunks are cut by rank, so none holds more than ``chunk_rows`` rows however the moments crowd. The rows are
    written out first, so that a task that is run again sees the same ranks.
    """
    seen = materialize(seen, "seen")
    hot = materialize(seen.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows).select("entity"), "hot")  # at most rows / chunk_rows
    if hot.isEmpty():
        return seen.withColumn("chunk", F.lit(0).cast("long"))
    hot = small(hot)
    many = numbered(seen.join(hot, "entity", "left_semi"), [F.col("entity"), F.col("at")], "__no", bucket_rows=chunk_rows)
    first = many.groupBy("entity").agg(F.min("__no").alias("__first"))
    many = many.join(small(first), "entity").withColumn("chunk", F.floor((F.col("__no") - F.col("__first")) / chunk_rows).cast("long"))
    return seen.join(hot, "entity", "left_anti").withColumn("chunk", F.lit(0).cast("long")).unionByName(many.drop("__no", "__first"))


def store(df: DataFrame, entity: str, at: str, order: str, attributes: list[str], chunk_rows: int = 100_000, every: int = 8) -> DataFrame:
    """The checkpoint-delta store as one table: (entity, chunk, at, opening, is_checkpoint, full, patch).

    ``full`` is set on checkpoints: the first of every ``every`` stored rows of a chunk. ``patch``, null on
    a chunk's first row only, maps each changed attribute to a one-field struct with its new value; an
    attribute that did not change is null there.
    """
    seen = chunked(observed(df, entity, at, order, attributes), chunk_rows)
    w = W.partitionBy("entity", "chunk").orderBy("at")
    before = seen.withColumn("before", F.lag("state").over(w)).withColumn("first", F.row_number().over(w) == 1)
    changed = F.lit(False)
    for a in attributes:
        changed = changed | ~_same(F.col(f"state.`{a}`"), F.col(f"before.`{a}`"))
    patch = F.struct(
        *[F.when(~_same(F.col(f"state.`{a}`"), F.col(f"before.`{a}`")), F.struct(F.col(f"state.`{a}`").alias("v"))).alias(a) for a in attributes]
    )
    stored = F.col("first") | changed
    number = F.sum(stored.cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))  # from 1
    due = (F.col("number") - 1) % every == 0
    return before.withColumn("number", number).where(stored).select(
        "entity",
        "chunk",
        "at",
        "opening",
        due.alias("is_checkpoint"),
        F.when(due, F.col("state")).alias("full"),
        F.when(~F.col("first"), patch).alias("patch"),
    )


def fold(stored: DataFrame, attributes: list[str]) -> DataFrame:
    """``stored`` with ``state``: each row's full version, folded forward from the nearest checkpoint."""
    w = W.partitionBy("entity", "chunk").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = []
    for a in attributes:
        new = F.when(F.col("is_checkpoint"), F.struct(F.col(f"full.`{a}`").alias("v"))).otherwise(F.col(f"patch.`{a}`"))
        parts.append(F.last(new, ignorenulls=True).over(w)["v"].alias(a))
    return stored.withColumn("state", F.struct(*parts))


def versions(stored: DataFrame, attributes: list[str], entity: str = "entity") -> DataFrame:
    """Validity rows: (entity, version_no, opening, valid_from, valid_to, attributes...).

    ``valid_to`` is null on the version that holds now. A chunk's first row that repeats the
    final state of the chunk before it opens no version. An empty store gives no rows.
    """
    s = fold(stored, attributes)
    patched = F.col("patch").isNotNull()
    # one row for each chunk: its first and last state and how many changes lie behind its first row
    ends = s.groupBy("entity", "chunk").agg(
        F.min(F.struct("at", "state")).getField("state").alias("first_state"),
        F.max(F.struct("at", "state")).getField("state").alias("last_state"),
        F.min("at").alias("chunk_at"),
        F.sum(patched.cast("long")).alias("patches"),
        F.min(F.when(patched, F.col("at"))).alias("first_patch_at"),
    )
    w = W.partitionBy("entity").orderBy("chunk")
    prior = F.lag("last_state").over(w)
    differs = F.lag("chunk").over(w).isNull()
    for a in attributes:
        differs = differs | ~_same(F.col(f"first_state.`{a}`"), prior[a])
    ends = ends.withColumn("opens", differs)
    own = F.col("patches") + F.col("opens").cast("long")
    starts_at = F.when(F.col("opens"), F.col("chunk_at")).otherwise(F.col("first_patch_at"))
    later = W.partitionBy("entity").orderBy("chunk").rowsBetween(1, W.unboundedFollowing)
    ends = ends.select(
        "entity",
        "chunk",
        "opens",
        (F.sum(own).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - own).alias("before_no"),
        F.first(starts_at, ignorenulls=True).over(later).alias("next_chunk_at"),
    )
    v = s.join(ends, ["entity", "chunk"]).where(patched | F.col("opens"))
    inside = W.partitionBy("entity", "chunk").orderBy("at")
    return v.select(
        F.col("entity").alias(entity),
        (F.col("before_no") + F.row_number().over(inside)).cast("int").alias("version_no"),
        "opening",
        F.col("at").alias("valid_from"),
        F.coalesce(F.lead("at").over(inside), F.col("next_chunk_at")).alias("valid_to"),
        *[F.col(f"state.`{a}`").alias(a) for a in attributes],
    )


def history(df: DataFrame, entity: str, at: str, order: str, attributes: list[str], chunk_rows: int = 100_000) -> DataFrame:
    """Store and reconstruct in one plan; see :func:`store` and :func:`versions`."""
    return versions(store(df, entity, at, order, attributes, chunk_rows), attributes, entity)


def as_of(stored: DataFrame, moment: Column, attributes: list[str], entity: str = "entity") -> DataFrame:
    """Each entity's version at ``moment``: only the checkpoint nearest before it and the patches since are folded.

    ``valid_from`` and ``opening`` are those of the last stored row, which is a checkpoint where a chunk began since the change.
    Entities not seen by then have no row.
    """
    upto = stored.where(F.col("at") <= moment)
    near = upto.where("is_checkpoint").groupBy("entity").agg(F.max("at").alias("near"))
    s = fold(upto.join(near, "entity").where(F.col("at") >= F.col("near")).drop("near"), attributes)
    last = s.groupBy("entity").agg(F.max(F.struct("at", "opening", "state")).alias("x"))
    return last.select(F.col("entity").alias(entity), F.col("x.at").alias("valid_from"), "x.opening", *[F.col(f"x.state.`{a}`").alias(a) for a in attributes])
