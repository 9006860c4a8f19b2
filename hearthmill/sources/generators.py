"""Generated tables: literal rows, series, date spines, calendar dimension."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmill.functions import datetimes as D


def literal_rows(spark: SparkSession, rows: list[dict], schema: T.StructType | str) -> DataFrame:
    """A typed table of literal rows. A missing column is null, an unknown one is an error, no rows give an empty table."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = set(kind.fieldNames())
    for r in rows:
        if odd := set(r) - names:
            raise ValueError(f"unknown columns: {', '.join(sorted(odd))}")
    return spark.createDataFrame([tuple(r.get(n) for n in kind.fieldNames()) for r in rows], kind)


def integer_series(spark: SparkSession, n: int, name: str = "generated_number") -> DataFrame:
    """1 to n."""
    return spark.range(1, n + 1).withColumnRenamed("id", name)


def date_spine(spark: SparkSession, start: date, end: date, part: str = "day", inclusive: bool = True, name: str = "date_day") -> DataFrame:
    """One row for each day, week, month, quarter or year from ``start`` on; the end is in it if ``inclusive``."""
    if part not in ("day", "week", "month", "quarter", "year"):
        raise ValueError(f"unknown date part: {part}")
    step = F.expr("interval 3 months" if part == "quarter" else f"interval 1 {part}")
    days = F.sequence(F.lit(start), F.lit(end), step) if start <= end else F.array().cast("array<date>")
    df = spark.range(1).select(F.explode(days).alias(name))
    return df if inclusive else df.where(F.col(name) < F.lit(end))


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Calendar dimension, one row for each day from ``start`` to ``end``."""
    d = F.col("full_date")
    return date_spine(spark, start, end, name="full_date").select(
        D.date_key(d).alias("date_key"),
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.weekofyear(d).alias("week"),
        F.dayofmonth(d).alias("day_of_month"),
        D.dow0(d).alias("day_of_week"),
        F.dayofyear(d).alias("day_of_year"),
        D.padded(d, "MMMM").alias("month_name"),
        F.date_format(d, "MMM").alias("month_short"),
        D.padded(d, "EEEE").alias("day_name"),
        F.date_format(d, "E").alias("day_short"),
        D.dow0(d).isin(0, 6).alias("is_weekend"),
        D.is_last_of("month", d).alias("is_month_end"),
        D.is_last_of("quarter", d).alias("is_quarter_end"),
        D.is_last_of("year", d).alias("is_year_end"),
        D.week_of_month(d).alias("week_of_month"),
        D.day_of_quarter(d).alias("day_of_quarter"),
        D.trunc_date(d, "week").alias("week_start"),
        D.trunc_date(d, "month").alias("month_start"),
        D.trunc_date(d, "quarter").alias("quarter_start"),
        D.trunc_date(d, "year").alias("year_start"),
        F.date_format(d, "yyyy-MM").alias("year_month"),
        F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string")).alias("year_quarter"),
        F.date_format(d, "MMdd").alias("month_day"),
    )
