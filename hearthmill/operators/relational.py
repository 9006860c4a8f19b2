"""Relational operators that one DataFrame call does not express.

Each composes built-in expressions, so that Catalyst plans it. Nulls in key
columns form their own group unless said otherwise; empty inputs give empty
results (global aggregates give their one row).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import MapType

BROADCAST_ROWS = 1_000_000


# --- first row per key ------------------------------------------------------------------------


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; keys that are null are equal. Extra columns ride along.

    It is an aggregate, not a window, where the order is plain: use :func:`keep_latest`
    for that. Give a full tiebreak, or which of tied rows is kept is open.
    """
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def keep_latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the greatest ``by`` columns of each key.

    Runs as a partial aggregate: every task first reduces its rows to one for each key, so a
    key with a third of all rows shuffles one row for each task, not all of them.
    Nulls in ``by`` lose against values. Columns of types without order (maps) are not allowed.
    """
    rest = [c for c in df.columns if c not in keys and c not in by]
    packed = F.struct(*[F.col(f"`{c}`") for c in [*by, *rest]])
    got = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max(packed).alias("__row"))
    return got.select(*[F.col(f"`{k}`") for k in keys], "__row.*").select(*[F.col(f"`{c}`") for c in df.columns])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key (Spark cuts each task's group to ``n`` before the shuffle)."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def at_latest(df: DataFrame, period: str) -> DataFrame:
    """Rows of the latest period: a one-row aggregate joined back."""
    latest = df.agg(F.max(period).alias("__latest"))
    return df.join(F.broadcast(latest), F.col(period) == F.col("__latest")).drop("__latest")


# --- pivots, changes, merges ------------------------------------------------------------------


def pivot_max(df: DataFrame, keys: list[str], label: str, value: str, columns: dict[str, list[str]]) -> DataFrame:
    """One column for each pattern list: the greatest value whose label matches (patterns may overlap)."""
    aggs = []
    for name, patterns in columns.items():
        hit = reduce(lambda a, b: a | b, [F.col(label).ilike(p) for p in patterns])
        aggs.append(F.max(F.when(hit, F.col(value))).alias(name))
    return df.groupBy(*keys).agg(*aggs)


def period_change(df: DataFrame, keys: list[str], order: str, value: str, lags: dict[str, int]) -> DataFrame:
    """For each named lag: ``<name>_before``, ``<name>_change`` and ``<name>_pct``, by rows present, not by calendar.

    Without keys the whole set is one series; that is for short series only, since it is one task.
    """
    w = W.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())
    for name, n in lags.items():
        df = df.withColumn(f"{name}_before", F.lag(value, n).over(w))
    for name in lags:
        b = F.col(f"{name}_before")
        df = df.withColumn(f"{name}_change", F.col(value) - b).withColumn(f"{name}_pct", (F.col(value) - b) / F.nullif(b, F.lit(0)) * 100)
    return df


def full_merge(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of several tables on common keys, each key coalesced over all; null keys match nothing."""
    return reduce(lambda a, b: a.join(b, keys, "full"), parts)


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts (by position), each once."""
    return reduce(lambda a, b: a.union(b), parts).distinct()


def union_all(parts: list[DataFrame], by_name: bool = False) -> DataFrame:
    """Rows of all parts, by position under the first part's names, or by name."""
    return reduce((lambda a, b: a.unionByName(b, allowMissingColumns=True)) if by_name else (lambda a, b: a.union(b)), parts)


# --- joins ------------------------------------------------------------------------------------


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if counting shows it has at most so many rows; else as it is, and Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(df: DataFrame, dim: DataFrame, on: Column | str | list[str], how: str = "left") -> DataFrame:
    """``df`` with a dimension's columns. The dimension is broadcast only if small; several matches repeat the row."""
    return df.join(small(dim), on, how)


def lookup_name(df: DataFrame, name: str, dim: DataFrame, dim_name: str, dim_key: str, out: str) -> DataFrame:
    """``df`` with the key of the entry of the same name, case aside; null without one. At most one match: the smallest key."""
    d = dim.groupBy(F.lower(dim_name).alias("__name")).agg(F.min(dim_key).alias(out))
    return df.join(small(d), F.lower(F.col(name)) == F.col("__name"), "left").drop("__name")


def anti_null_safe(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys ``other`` does not have; null equals null."""
    o = other.select(*[F.col(f"`{k}`").alias(f"__o_{i}") for i, k in enumerate(keys)]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__o_{i}")) for i, k in enumerate(keys)])
    return df.join(o, on, "left_anti")


def semi(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys ``other`` has (a tuple IN); null keys match nothing."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def with_constant_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table on every row; a table of more rows is an error, one of none gives nulls."""
    if row.limit(2).count() > 1:
        raise ValueError("expected one row at most")
    return df.join(F.broadcast(row), F.lit(True), "left")


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", salts: int = 16, hot: DataFrame | None = None) -> DataFrame:
    """Equi-join in which hot keys of ``big`` are spread over ``salts`` tasks.

    ``hot``: the hot keys (columns ``keys``); found by counting where not given (keys with more than
    1/(4 * salts) of the rows, so there are at most 4 * salts of them). Only their rows in ``other`` are
    repeated, once for each salt. Inner and left joins; null keys match nothing. A row's salt is a hash
    of the row, so a task that is run again spreads its rows in the same way.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join takes inner and left joins")
    if hot is None:
        counts = big.groupBy(*keys).agg(F.count("*").alias("__n"))
        total = counts.agg(F.sum("__n").alias("__t"))
        hot = counts.join(F.broadcast(total)).where(F.col("__n") * (4 * salts) > F.col("__t")).select(*keys)
    spread = [F.col(f"`{f.name}`") for f in big.schema if not isinstance(f.dataType, MapType)]
    h = F.broadcast(hot.select(*keys).distinct().withColumn("__hot", F.lit(True)))
    b = big.join(h, keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    o = other.join(h, keys, "left")
    o = o.withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return b.join(o, [*keys, "__salt"], how).drop("__salt")


# --- aggregates -------------------------------------------------------------------------------


def exact_percentiles(value: str, probs: dict[str, float]) -> list[Column]:
    """Interpolated percentiles as aggregate columns, exact. For groups beyond memory use a sketch instead."""
    return [F.percentile(F.col(value), p).alias(n) for n, p in probs.items()]


def share_where(condition: Column, scale: float = 100.0) -> Column:
    """Share of rows for which a condition is true, as an aggregate column; null for no rows."""
    return F.try_divide(F.count_if(condition) * scale, F.count(F.lit(1)))


def distinct_list(df: DataFrame, keys: list[str], item: str, out: str, separator: str = ",", limit: int | None = None) -> DataFrame:
    """Sorted distinct items of each key as text; with ``limit`` only that many are ever collected for a key.

    Without a limit the list of a key grows with its distinct items.
    """
    d = df.select(*keys, item).where(F.col(item).isNotNull()).distinct()
    if limit is not None:
        d = top_n(d, keys, [F.col(item)], limit)
    return d.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(item)), separator).alias(out))


def numbered(df: DataFrame, order: list[Column], out: str = "key", start: int = 1, bucket_rows: int = 1_000_000) -> DataFrame:
    """``df`` with consecutive numbers in a total order, without bringing all rows to one task.

    Rows are range-partitioned by the order and written out, so a retried task sees the same split;
    a row's number is its place in its partition plus the sizes of the partitions before it.
    """
    from hearthmill.session import materialize

    parts = max(1, df.count() // bucket_rows)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    kept = materialize(ranged.withColumn("__i", F.monotonically_increasing_id()), "numbered")
    sizes = kept.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).select("__p", "__before")  # a row for each partition
    place = F.row_number().over(W.partitionBy("__p").orderBy("__i"))
    return kept.join(F.broadcast(before), "__p").withColumn(out, F.col("__before") + place + (start - 1)).drop("__p", "__i", "__before")
