"""Named queries of the general data problems 1, 4, 6 and 7, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmill.operators import geo, history, packed, units
from hearthmill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- 1: quantities in different units ---------------------------------------------------------

_MONTHLY_SQL = r"""
WITH t AS (
  SELECT id, price, regexp_replace(lower(price_raw), '\(.*', '') AS s
  FROM raw_daft_listings WHERE price IS NOT NULL AND regexp_matches(price_raw, '[0-9]')),
n AS (SELECT *, regexp_extract(s, '[0-9]+(?:[.,][0-9]+)*') AS num, regexp_matches(s, '[0-9]k|thousand') AS k FROM t),
v AS (
  SELECT *, CASE
      WHEN num LIKE '%.%,%' THEN CAST(replace(replace(num, '.', ''), ',', '.') AS DOUBLE)
      WHEN num LIKE '%,%.%' THEN CAST(replace(num, ',', '') AS DOUBLE)
      WHEN k THEN CAST(replace(num, ',', '.') AS DOUBLE)
      WHEN regexp_matches(num, '^[0-9]{1,3}([.,][0-9]{3})+$') THEN CAST(regexp_replace(num, '[.,]', '', 'g') AS DOUBLE)
      ELSE CAST(replace(num, ',', '.') AS DOUBLE) END * CASE WHEN k THEN 1000 ELSE 1 END AS amount
  FROM n),
m AS (
  SELECT id, price, amount * CASE
      WHEN regexp_matches(s, 'fortnight|two weeks') THEN 26.0 / 12
      WHEN regexp_matches(s, 'three months|quarter') THEN 1.0 / 3
      WHEN regexp_matches(s, 'week|/wk| pw') THEN 52.0 / 12
      WHEN regexp_matches(s, 'daily|per day|per night') THEN 365.0 / 12
      WHEN regexp_matches(s, 'year|annum|p\.a') THEN 1.0 / 12
      ELSE 1.0 END AS monthly
  FROM v)
"""


@_query("p1_found", _MONTHLY_SQL + "SELECT id FROM m WHERE abs(CAST(price AS DOUBLE) - monthly) > monthly * 0.02 + 1e-9")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "raw_daft_listings").select("id", "price", "price_raw")
    return units.unit_conflicts(df, "price", "price_raw").select("id")


@_query("p1_monthly", _MONTHLY_SQL + "SELECT id, round(monthly, 2) AS euro_per_month FROM m")
def p1_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Every readable quoted amount in euro per month."""
    df = table(spark, sf, "raw_daft_listings").select("id", "price", "price_raw").where("price IS NOT NULL AND price_raw RLIKE '[0-9]'")
    return units.with_common_unit(df, "price_raw", "m").select("id", F.round("m", 2).alias("euro_per_month")).where("euro_per_month IS NOT NULL")


# --- 4: points near other points --------------------------------------------------------------


@_query(
    "p4_found",
    """
WITH p AS (
  SELECT listing_key AS k, radians(CAST(latitude AS DOUBLE)) AS a, radians(CAST(longitude AS DOUBLE)) AS o
  FROM fact_rental_listings WHERE latitude BETWEEN 51 AND 56 AND longitude BETWEEN -11 AND -5)
SELECT x.k AS listing_key, y.k AS near_key FROM p x JOIN p y ON x.k < y.k AND abs(x.a - y.a) < 0.000005
WHERE 2 * 6371000 * asin(least(1.0, sqrt(pow(sin((y.a - x.a) / 2), 2) + cos(x.a) * cos(y.a) * pow(sin((y.o - x.o) / 2), 2)))) <= 30
""",
)
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "fact_rental_listings").where(F.col("latitude").between(51, 56) & F.col("longitude").between(-11, -5))
    return geo.near_pairs(df, "listing_key", "latitude", "longitude", 30.0, max_abs_lat=56.0, first="listing_key", second="near_key").select(
        "listing_key", "near_key"
    )


# --- 6: several values in one field -----------------------------------------------------------


@_query(
    "p6_found",
    r"""
WITH t AS (
  SELECT id, 'sections' AS field, sections AS s FROM raw_daft_listings WHERE sections IS NOT NULL
  UNION ALL SELECT id, 'sale_type', sale_type FROM raw_daft_listings WHERE sale_type IS NOT NULL),
b AS (
  SELECT id, field, ',' || CASE WHEN regexp_matches(s, '(?s)^\s*\[.*\]\s*$') THEN regexp_extract(s, '(?s)^\s*\[(.*)\]\s*$', 1) ELSE s END AS s FROM t),
x AS (
  SELECT id, field, regexp_extract_all(s, '[,;|\t\n]([ ]*"(?:[^"\\]|""|\\.)*"[ ]*|[ ]*''[^'']*''[ ]*|[^,;|\t\n]*)', 1) AS a FROM b),
u AS (SELECT id, field, unnest(a) AS p, generate_subscripts(a, 1) AS pos FROM x),
c AS (SELECT id, field, pos, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM u),
d AS (
  SELECT id, field, pos, trim(CASE
      WHEN p LIKE '"%"' THEN regexp_replace(replace(p[2:-2], '""', '"'), '\\(.)', '\1', 'g')
      WHEN p LIKE '''%''' THEN p[2:-2] ELSE p END) AS item FROM c)
SELECT id, field, CAST(pos AS INTEGER) AS pos, item FROM d WHERE item <> ''
""",
)
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "raw_daft_listings").select("id", "sections", "sale_type", "source")
    return packed.split_values(df, "id", ["sections", "sale_type"], "source")


# --- 7: history of changing attributes --------------------------------------------------------

_VERSIONS_SQL = """
WITH s AS (
  SELECT property_id, scraped_at, max(id) AS id FROM raw_daft_listings WHERE price IS NOT NULL AND property_id IS NOT NULL AND scraped_at IS NOT NULL GROUP BY 1, 2),
p AS (SELECT s.*, r.price FROM s JOIN raw_daft_listings r USING (id)),
l AS (SELECT *, lag(price) OVER (PARTITION BY property_id ORDER BY scraped_at) AS before FROM p),
v AS (
  SELECT property_id, id AS opening_id, scraped_at AS valid_from, price,
         row_number() OVER (PARTITION BY property_id ORDER BY scraped_at) AS version_no,
         lead(scraped_at) OVER (PARTITION BY property_id ORDER BY scraped_at) AS valid_to
  FROM l WHERE price IS DISTINCT FROM before)
"""


def _listing_history(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "raw_daft_listings").select("property_id", "scraped_at", "id", "price").where("price IS NOT NULL")
    return history.history(df, "property_id", "scraped_at", "id", ["price"])


@_query("p7_found", _VERSIONS_SQL + "SELECT property_id, CAST(version_no AS INTEGER) AS version_no, opening_id FROM v")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _listing_history(spark, sf).select("property_id", "version_no", F.col("opening").alias("opening_id"))


@_query("p7_validity", _VERSIONS_SQL + "SELECT property_id, CAST(version_no AS INTEGER) AS version_no, valid_from, valid_to, price FROM v")
def p7_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Validity rows: each price with the time from which it held until the next one began."""
    return _listing_history(spark, sf).select("property_id", "version_no", "valid_from", "valid_to", "price")


@_query("p7_as_of", _VERSIONS_SQL + "SELECT property_id, price FROM v WHERE valid_from <= TIMESTAMP '2025-04-01' AND (valid_to > TIMESTAMP '2025-04-01' OR valid_to IS NULL)")
def p7_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each property's price at a moment, from the nearest checkpoint and the patches since."""
    df = table(spark, sf, "raw_daft_listings").select("property_id", "scraped_at", "id", "price").where("price IS NOT NULL")
    stored = history.store(df, "property_id", "scraped_at", "id", ["price"])
    return history.as_of(stored, F.lit("2025-04-01").cast("timestamp_ntz"), ["price"], "property_id").select("property_id", "price")
