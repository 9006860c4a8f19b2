"""Queries of the scalar functions: strings, dates, numbers, arrays, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmill.functions import arrays as A
from hearthmill.functions import datetimes as D
from hearthmill.functions import numbers as N
from hearthmill.functions import strings as S
from hearthmill.queries.base import Named
from hearthmill.session import table

query = Named()
QUERIES, SQL = query.QUERIES, query.SQL


@query(
    "q_strings",
    r"""
SELECT id, trim(county) AS trimmed, lower(title) AS low, upper(ber_rating) AS up, length(title) AS n, coalesce(CAST(county AS VARCHAR), '') || '/' || coalesce(CAST(bedrooms AS VARCHAR), '') AS joined,
  county || '/' || ber_rating AS piped, replace(title, 'Co.', 'County') AS replaced, right(title, 5) AS tail, position('o' IN title) AS at,
  split_part(title, ',', 1) AS first_part, split_part(title, ',', -1) AS last_part, substr(title, 3, 8) AS middle, md5(title) AS hash, CASE WHEN premier_partner IS NULL THEN NULL WHEN premier_partner THEN 'true' ELSE 'false' END AS flag,
  try_cast(nullif(regexp_replace(price_raw, '[^\d.]', '', 'g'), '') AS DOUBLE) AS price_number, try_cast(nullif(regexp_replace(num_bedrooms_raw, '[^\d]', '', 'g'), '') AS INTEGER) AS bed_number
FROM raw_daft_listings
""",
)
def strings(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("title")
    return table(spark, sf, "raw_daft_listings").select(
        "id",
        F.trim("county").alias("trimmed"),
        F.lower(t).alias("low"),
        F.upper("ber_rating").alias("up"),
        F.length(t).cast("long").alias("n"),
        S.concat_nulls_empty(F.col("county"), F.lit("/"), F.col("bedrooms")).alias("joined"),
        F.concat("county", F.lit("/"), "ber_rating").alias("piped"),
        F.replace(t, F.lit("Co."), F.lit("County")).alias("replaced"),
        F.right(t, F.lit(5)).alias("tail"),
        F.locate("o", t).cast("long").alias("at"),
        S.split_nth(t, ",", 1).alias("first_part"),
        S.split_nth(t, ",", -1).alias("last_part"),
        F.substring(t, 3, 8).alias("middle"),
        S.text_hash(t).alias("hash"),
        S.bool_text(F.col("premier_partner")).alias("flag"),
        S.digits_to_double(F.col("price_raw")).alias("price_number"),
        S.digits_to_int(F.col("num_bedrooms_raw")).alias("bed_number"),
    )


@query(
    "q_initcap",
    """
WITH w AS (SELECT s_suppkey, unnest(regexp_extract_all(lower(s_name || '-of nation ' || s_nationkey || '''s o''neill co-op'), '[a-z0-9]+|[^a-z0-9]+')) AS p,
  generate_subscripts(regexp_extract_all(lower(s_name || '-of nation ' || s_nationkey || '''s o''neill co-op'), '[a-z0-9]+|[^a-z0-9]+'), 1) AS i FROM supplier)
SELECT s_suppkey, string_agg(upper(substr(p, 1, 1)) || substr(p, 2), '' ORDER BY i) AS name FROM w GROUP BY 1
""",
)
def initcap(spark: SparkSession, sf: str) -> DataFrame:
    """Capitals after every character that is no letter or digit."""
    text = F.concat("s_name", F.lit("-of nation "), F.col("s_nationkey").cast("string"), F.lit("'s o'neill co-op"))
    return table(spark, sf, "supplier").select("s_suppkey", S.initcap_words(text).alias("name"))


_NAMES = ["Dublin", "Cork", "Galway", "Limerick", "Waterford", "Kilkenny", "Wexford", "Carlow", "Kildare", "Meath", "Louth", "Wicklow"]


@query("q_first_contained", "SELECT id, CASE " + " ".join(f"WHEN upper(title) LIKE '%{n.upper()}%' THEN '{n}'" for n in _NAMES) + " END AS county FROM raw_daft_listings")
def first_contained(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_daft_listings").select("id", S.first_contained(F.col("title"), _NAMES).alias("county"))


@query(
    "q_surrogate_key",
    "SELECT id, md5(coalesce(county, '_dbt_utils_surrogate_key_null_') || '-' || coalesce(CAST(bedrooms AS VARCHAR), '_dbt_utils_surrogate_key_null_') || '-' || coalesce(property_type, '_dbt_utils_surrogate_key_null_')) AS key, md5(coalesce(county, '') || '|' || coalesce(CAST(bedrooms AS VARCHAR), '')) AS row_id FROM raw_daft_listings",
)
def surrogate_key(spark: SparkSession, sf: str) -> DataFrame:
    c, b, p = F.col("county"), F.col("bedrooms"), F.col("property_type")
    return table(spark, sf, "raw_daft_listings").select("id", S.surrogate_key(c, b, p).alias("key"), S.row_hash(c, b).alias("row_id"))


@query(
    "q_dates",
    """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m,
  day(o_orderdate) AS dom, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS w, dayofweek(o_orderdate) AS dow, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS key, rpad(strftime(o_orderdate, '%B'), 9, ' ') AS month_name, strftime(o_orderdate, '%b') AS mon, strftime(o_orderdate, '%Y-%m') AS ym,
  last_day(o_orderdate) AS month_end, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, CAST(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS year_end,
  CAST(ceil(day(o_orderdate) / 7.0) AS BIGINT) AS week_of_month, date_diff('day', date_trunc('quarter', o_orderdate), o_orderdate) + 1 AS day_of_quarter,
  CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(o_orderdate - INTERVAL 2 QUARTER AS DATE) AS half_year_ago, CAST(o_orderdate + INTERVAL 3 WEEK AS DATE) AS in_three_weeks, make_date(year(o_orderdate), 1, 1) AS jan1
FROM orders
""",
)
def dates(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderdate")
    d = o.cast("date")
    big = lambda c: c.cast("long")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        d.alias("d"),
        D.trunc_date(o, "week").alias("week_start"),
        D.trunc_date(o, "quarter").alias("quarter_start"),
        big(F.year(o)).alias("y"),
        big(F.quarter(o)).alias("q"),
        big(F.month(o)).alias("m"),
        big(F.dayofmonth(o)).alias("dom"),
        big(F.dayofyear(o)).alias("doy"),
        big(F.weekofyear(o)).alias("w"),
        big(D.dow0(o)).alias("dow"),
        D.date_key(o).alias("key"),
        D.padded(o, "MMMM").alias("month_name"),
        F.date_format(o, "MMM").alias("mon"),
        F.date_format(o, "yyyy-MM").alias("ym"),
        D.last_of("month", d).alias("month_end"),
        D.last_of("quarter", d).alias("quarter_end"),
        D.last_of("year", d).alias("year_end"),
        big(D.week_of_month(d)).alias("week_of_month"),
        big(D.day_of_quarter(d)).alias("day_of_quarter"),
        D.add("month", 1, d).cast("date").alias("next_month"),
        D.add("quarter", -2, d).cast("date").alias("half_year_ago"),
        D.add("week", 3, d).cast("date").alias("in_three_weeks"),
        F.make_date(F.year(o), F.lit(1), F.lit(1)).alias("jan1"),
    )


@query("q_epoch_millis", "SELECT id, CASE WHEN publish_date >= 100000000000 THEN make_timestamp(publish_date * 1000) END AS published, CASE WHEN publish_date >= 100000000000 THEN date_diff('day', CAST(make_timestamp(publish_date * 1000) AS DATE), CAST(scraped_at AS DATE)) END AS days FROM raw_daft_listings")
def epoch_millis(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("publish_date") >= 100_000_000_000, D.from_millis(F.col("publish_date")))
    return table(spark, sf, "raw_daft_listings").select("id", p.cast("timestamp_ntz").alias("published"), D.days_between(F.to_date("scraped_at"), F.to_date(p)).cast("long").alias("days"))


@query(
    "q_boundaries",
    """
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate + to_microseconds(l_partkey * 1237) AS x, o_orderdate + to_microseconds(l_orderkey * 777) AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_linenumber % 2 = 0 THEN x ELSE y END AS s, CASE WHEN l_linenumber % 2 = 0 THEN y ELSE x END AS e FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, date_diff('year', s, e) AS years, date_diff('quarter', s, e) AS quarters, date_diff('month', s, e) AS months, date_diff('day', s, e) AS days, date_diff('hour', s, e) AS hours, date_diff('minute', s, e) AS minutes, date_diff('second', s, e) AS seconds, date_diff('millisecond', s, e) AS millis, date_diff('microsecond', s, e) AS micros,
  CAST(trunc(date_diff('day', s, e) / 7.0) + CASE WHEN dayofweek(s) <= dayofweek(e) THEN CASE WHEN s <= e THEN 0 ELSE -1 END ELSE CASE WHEN s <= e THEN 1 ELSE 0 END END AS BIGINT) AS weeks FROM p
""",
)
def boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Moments with fractions of a second, every other pair backwards."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    j = li.join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = F.timestamp_add("MICROSECOND", F.col("l_partkey") * 1237, F.col("l_shipdate"))
    y = F.timestamp_add("MICROSECOND", F.col("l_orderkey") * 777, F.col("o_orderdate"))
    back = F.col("l_linenumber") % 2 == 0
    j = j.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.when(back, x).otherwise(y).alias("s"), F.when(back, y).otherwise(x).alias("e"))
    parts = {"years": "year", "quarters": "quarter", "months": "month", "days": "day", "hours": "hour", "minutes": "minute", "seconds": "second", "millis": "millisecond", "micros": "microsecond", "weeks": "week"}
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", *[D.boundaries(p, F.col("s"), F.col("e")).alias(n) for n, p in parts.items()])


@query("q_period_year", "SELECT id, try_cast(substr(trim(time_period), 1, 4) AS INTEGER) AS y FROM raw_cso_rent")
def period_year(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_cso_rent").select("id", D.year_of_period(F.col("time_period")).alias("y"))


@query(
    "q_numbers",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(round(l_extendedprice / 7) AS INTEGER) AS rounded, floor(l_extendedprice) AS low, ceil(l_extendedprice) AS high, round(pow(l_discount * 10, 2), 6) AS squared,
  round(l_extendedprice / nullif(l_tax, 0), 4) AS guarded, round((l_extendedprice - l_quantity) / nullif(l_quantity, 0) * 100, 4) AS pct, try_cast(l_returnflag AS INTEGER) AS bad
FROM lineitem
""",
)
def numbers(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        N.to_int(e / 7).alias("rounded"), F.floor(e).cast("double").alias("low"), F.ceil(e).cast("double").alias("high"), F.round(F.pow(F.col("l_discount") * 10, 2), 6).alias("squared"),
        F.round(N.ratio(e, F.col("l_tax")), 4).alias("guarded"), F.round(N.percent_change(e, F.col("l_quantity")), 4).alias("pct"), N.safe_cast(F.col("l_returnflag"), "int").alias("bad"),
    )


@query(
    "q_arrays",
    "SELECT n_nationkey, array_to_string(list_append([n_nationkey, n_regionkey], 7), ',') AS appended, array_to_string(list_concat([n_nationkey], [1, 2]), ',') AS joined, list_contains([1, 3, 5], n_nationkey) AS hit, array_to_string([n_nationkey, n_regionkey, 9][1:2], '-') AS sliced FROM nation",
)
def arrays(spark: SparkSession, sf: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    text = lambda a, s: F.array_join(a.cast("array<string>"), s)
    return table(spark, sf, "nation").select(
        "n_nationkey",
        text(A.append(A.typed_array(k, r), F.lit(7)), ",").alias("appended"),
        text(A.join_arrays(F.array(k), A.typed_array(F.lit(1), F.lit(2))), ",").alias("joined"),
        F.array_contains(F.array(F.lit(1), F.lit(3), F.lit(5)), k).alias("hit"),
        text(F.slice(F.array(k, r, F.lit(9)), 1, 2), "-").alias("sliced"),
    )


@query("q_json_field", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_field(spark: SparkSession, sf: str) -> DataFrame:
    p = F.from_json("props", "k bigint, missing string")
    return table(spark, sf, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], F.lit("none")).alias("missing"))


@query("q_sql_function", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS key FROM orders")
def sql_function(spark: SparkSession, sf: str) -> DataFrame:
    """A scalar SQL function, inlined into the plan."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hearthmill_date_key(d DATE) RETURNS INT RETURN CAST(date_format(d, 'yyyyMMdd') AS INT)")
    table(spark, sf, "orders").createOrReplaceTempView("hearthmill_orders")
    return spark.sql("SELECT o_orderkey, hearthmill_date_key(CAST(o_orderdate AS DATE)) AS key FROM hearthmill_orders")
