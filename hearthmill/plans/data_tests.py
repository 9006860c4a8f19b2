"""Declarative data tests: each is a query for the rows that fail."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- failing rows -----------------------------------------------------------------------------


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their number; null is no value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("unique_field")).agg(F.count("*").alias("n_records")).where("n_records > 1")


def not_null(df: DataFrame, column: str, whole: bool = False) -> DataFrame:
    """Rows with null in the column: that column, or the whole row."""
    bad = df.where(F.col(column).isNull())
    return bad if whole else bad.select(column)


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Values outside the list, with their number; null passes."""
    return df.groupBy(F.col(column).alias("value_field")).agg(F.count("*").alias("n_records")).where(~F.col("value_field").isin(values))


def relationships(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Child values without a parent; null is no value."""
    c = child.where(F.col(column).isNotNull()).select(F.col(column).alias("from_field"))
    return c.join(parent.select(F.col(field).alias("to_field")).where(F.col("to_field").isNotNull()).distinct(), F.col("from_field") == F.col("to_field"), "left_anti")


def aggregated_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, failures) of several columns in one pass over the data."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("failures")) for i, c in enumerate(columns)])
    return row.select(F.inline(pairs)).where("failures > 0")


def aggregated_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, number) of the repeated values of several columns, read in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n_records")).where("n_records > 1")


def unique_key(df: DataFrame, keys: list[str], null_as: object | None = None) -> DataFrame:
    """Keys that break a unique index; with ``null_as`` null counts as that value, else a null never clashes."""
    cols = [F.coalesce(F.col(f"`{k}`"), F.lit(null_as)).alias(k) if null_as is not None else F.col(f"`{k}`") for k in keys]
    d = df.select(*cols)
    return (d if null_as is not None else d.na.drop(subset=keys)).groupBy(*keys).agg(F.count("*").alias("n_records")).where("n_records > 1")


def only_where(df: DataFrame, condition: str | None) -> DataFrame:
    """The rows that a test is restricted to."""
    return df if condition is None else df.where(condition)


# --- evaluation -------------------------------------------------------------------------------


@dataclass
class Outcome:
    failures: int
    should_warn: bool
    should_error: bool

    @property
    def status(self) -> str:
        return "error" if self.should_error else "warn" if self.should_warn else "pass"


def evaluation(failing: DataFrame, fail_calc: str = "count(*)", warn_if: str = "!= 0", error_if: str = "!= 0", limit: int | None = None) -> DataFrame:
    """One row (failures, should_warn, should_error). ``limit`` bounds the failing rows that are counted."""
    rows = failing if limit is None else failing.limit(limit)
    n = rows.agg(F.coalesce(F.expr(fail_calc).cast("long"), F.lit(0)).alias("failures"))
    return n.select("failures", F.expr(f"failures {warn_if}").alias("should_warn"), F.expr(f"failures {error_if}").alias("should_error"))


def run(failing: DataFrame, **options) -> Outcome:
    r = evaluation(failing, **options).first()
    return Outcome(r.failures, r.should_warn, r.should_error)


def store_failures(store, name: str, failing: DataFrame) -> DataFrame:
    """Keep the failing rows as a table."""
    return store.write(name, failing)


def unit_test(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows in which actual and expected differ, repeats counted, tagged by ``actual_or_expected``."""
    a = actual.select(*expected.columns)
    return a.exceptAll(expected).withColumn("actual_or_expected", F.lit("actual")).unionByName(expected.exceptAll(a).withColumn("actual_or_expected", F.lit("expected")))


def freshness(df: DataFrame, loaded_at: str, as_of=None) -> DataFrame:
    """One row (max_loaded_at, snapshotted_at, age_seconds); nulls for an empty table."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of)
    m = df.agg(F.max(loaded_at).alias("max_loaded_at")).withColumn("snapshotted_at", now)
    return m.withColumn("age_seconds", F.unix_timestamp(F.col("snapshotted_at").cast("timestamp")) - F.unix_timestamp(F.col("max_loaded_at").cast("timestamp")))


def contract(df: DataFrame, declared: T.StructType | str) -> list[tuple[str, str, str]]:
    """(column, declared, actual) of every mismatch in name or type; empty if the contract holds. Reads no data."""
    want = declared if isinstance(declared, T.StructType) else T._parse_datatype_string(declared)
    a, b = {f.name: f.dataType.simpleString() for f in want}, {f.name: f.dataType.simpleString() for f in df.schema}
    return [(n, a.get(n, "missing"), b.get(n, "missing")) for n in dict.fromkeys([*a, *b]) if a.get(n) != b.get(n)]


def prerequisites(counts: dict[str, int], required: list[str]) -> list[str]:
    """Required tables that are absent or empty."""
    return [t for t in required if not counts.get(t)]


def explains(df: DataFrame) -> str:
    """The plan, made but not run: proof that a query is valid."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def all_failures(parts: dict[str, DataFrame]) -> DataFrame:
    """(test, failures) of several tests."""
    return reduce(DataFrame.unionByName, [p.agg(F.count("*").alias("failures")).select(F.lit(n).alias("test"), "failures") for n, p in parts.items()])
