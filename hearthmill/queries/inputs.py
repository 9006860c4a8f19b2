"""Queries of sources and generators: spines, series, literals, cubes, pages, loaders."""

from __future__ import annotations

import itertools
import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmill.plans import loaders
from hearthmill.plans.store import TableStore
from hearthmill.queries.base import Named
from hearthmill.session import new_path, table
from hearthmill.sources import files, generators

query = Named()
QUERIES, SQL = query.QUERIES, query.SQL


@query(
    "q_dim_date",
    """
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, CAST(weekofyear(d) AS INTEGER) AS week, CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofweek(d) AS INTEGER) AS day_of_week, CAST(dayofyear(d) AS INTEGER) AS day_of_year,
  rpad(strftime(d, '%B'), 9, ' ') AS month_name, strftime(d, '%b') AS month_short, rpad(strftime(d, '%A'), 9, ' ') AS day_name, strftime(d, '%a') AS day_short, dayofweek(d) IN (0, 6) AS is_weekend,
  last_day(d) = CAST(d AS DATE) AS is_month_end, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) = CAST(d AS DATE) AS is_quarter_end, month(d) = 12 AND day(d) = 31 AS is_year_end,
  CAST(ceil(day(d) / 7.0) AS INTEGER) AS week_of_month, CAST(date_diff('day', date_trunc('quarter', d), d) + 1 AS INTEGER) AS day_of_quarter, CAST(date_trunc('week', d) AS DATE) AS week_start, CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(date_trunc('quarter', d) AS DATE) AS quarter_start, CAST(date_trunc('year', d) AS DATE) AS year_start,
  strftime(d, '%Y-%m') AS year_month, year(d) || '-Q' || quarter(d) AS year_quarter, strftime(d, '%m%d') AS month_day
FROM generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2030-12-31', INTERVAL 1 DAY) t(d)
""",
)
def dim_date(spark: SparkSession, sf: str) -> DataFrame:
    return generators.calendar(spark, date(2000, 1, 1), date(2030, 12, 31))


@query("q_date_spine", "SELECT CAST(d AS DATE) AS date_month FROM generate_series(TIMESTAMP '2020-01-01', TIMESTAMP '2024-11-01', INTERVAL 1 MONTH) t(d)")
def date_spine(spark: SparkSession, sf: str) -> DataFrame:
    """End-exclusive spine of months."""
    return generators.date_spine(spark, date(2020, 1, 1), date(2024, 12, 1), "month", inclusive=False, name="date_month")


@query("q_integer_series", "SELECT CAST(n AS BIGINT) AS generated_number FROM range(1, 1001) t(n)")
def integer_series(spark: SparkSession, sf: str) -> DataFrame:
    return generators.integer_series(spark, 1000)


@query("q_literal_rows", "SELECT * FROM (VALUES ('Low', 0, 1000), ('Middle', 1000, 1500), ('High', 1500, NULL)) t(name, low, high)")
def literal_rows(spark: SparkSession, sf: str) -> DataFrame:
    return generators.literal_rows(spark, [{"name": "Low", "low": 0, "high": 1000}, {"name": "Middle", "low": 1000, "high": 1500}, {"name": "High", "low": 1500}], "name string, low int, high int")


_CUBE = {
    "id": ["STATISTIC", "TLIST(A1)", "C1"],
    "size": [2, 2, 3],
    "value": [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0],
    "dimension": {
        "STATISTIC": {"label": "Statistic", "category": {"index": ["S1", "S2"], "label": {"S1": "First", "S2": "Second"}}},
        "TLIST(A1)": {"label": "Year", "category": {"index": {"2021": 1, "2020": 0}, "label": {"2020": "2020", "2021": "2021"}}},
        "C1": {"label": "Place", "category": {"index": ["A", "B", "C"], "label": {"A": "Alpha", "B": "Beta"}}},
    },
}


@query(
    "q_jsonstat",
    "SELECT s AS \"STATISTIC\", CASE s WHEN 'S1' THEN 'First' ELSE 'Second' END AS \"STATISTIC_Label\", y AS \"TLIST(A1)\", y AS \"TLIST(A1)_Label\", c AS \"C1\", CASE c WHEN 'A' THEN 'Alpha' WHEN 'B' THEN 'Beta' ELSE c END AS \"C1_Label\", CAST(value AS DOUBLE) AS value FROM (VALUES "
    + ", ".join(f"('{s}', '{y}', '{c}', {v})" for (s, y, c), v in zip([(s, y, c) for s in ("S1", "S2") for y in ("2020", "2021") for c in "ABC"], ["1.0", "2.0", "NULL", *[f"{i}.0" for i in range(4, 12)]], strict=False))
    + ") t(s, y, c, value)",
)
def jsonstat(spark: SparkSession, sf: str) -> DataFrame:
    """A cube with one value too few, an index written as a map and a code without a label."""
    df = spark.createDataFrame([(json.dumps(_CUBE),)], "body string")
    return files.flatten_cube(df, "body", _CUBE["id"]).drop("position")


_LISTING = {"id": "7", "title": "12 Ivy Road, Swords, Co. Dublin", "price": "€1,500 per month", "numBedrooms": "2 bed", "sections": ["Apartments", "To Let"], "publishDate": 1735740763158, "point": {"coordinates": [-6.25, 53.35]}, "seller": {"sellerId": 3, "name": "Oxbow"}, "media": {"totalImages": 4, "hasVideo": True}, "ber": {"rating": "B2"}}
_PAGE = '<html><head><title> Rentals </title></head><script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"listings": [{"listing": _LISTING}, {"listing": {"id": "8", "title": "Room, Galway"}}]}}}) + "</script></html>"


@query(
    "q_html_json",
    "SELECT * REPLACE (CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon) FROM (VALUES ('7', 'Dublin', CAST(1500.00 AS DECIMAL(10,2)), 2, 'Apartments,To Let', CAST(1735740763158 AS BIGINT), 53.35, -6.25, 'Oxbow', 'B2'), ('8', 'Galway', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)) t(property_id, county, price, bedrooms, sections, publish_date, lat, lon, seller_name, ber_rating)",
)
def html_json(spark: SparkSession, sf: str) -> DataFrame:
    """Listings out of a page's embedded data, flattened; pages without any give no row."""
    pages = spark.createDataFrame([(1, _PAGE), (2, "<html>nothing</html>"), (3, None)], "page_id int, html string")
    items = files.embedded_rows(pages, "html", "__NEXT_DATA__", ["props", "pageProps", "listings"], f"struct<listing:{loaders.LISTING_JSON}>")
    flat = loaders.flatten_listing(items.select(F.col("item.listing").alias("l")), "l", ["Dublin", "Cork", "Galway"])
    return flat.select("property_id", "county", "price", "bedrooms", "sections", "publish_date", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"), "seller_name", "ber_rating")


@query(
    "q_loader",
    """
WITH k AS (SELECT DISTINCT ON (property_id, publish_date) id, property_id, publish_date, price FROM raw_daft_listings ORDER BY property_id, publish_date, id),
a AS (SELECT DISTINCT ON (property_id, publish_date) id, property_id, publish_date, price FROM listing_arrivals ORDER BY property_id, publish_date, id)
SELECT property_id, publish_date, price FROM k
UNION ALL SELECT property_id, publish_date, price FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.property_id = a.property_id AND k.publish_date IS NOT DISTINCT FROM a.publish_date)
""",
)
def loader(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads of the same feed: the first row of each key as written, then what the table lacks."""
    store = TableStore(spark, new_path(spark, "bronze"))
    feed = loaders.Feed("listings", "id long, property_id string, publish_date long, price decimal(10,2)", ["property_id", "publish_date"], first_by=["id"])
    for t in ("raw_daft_listings", "listing_arrivals"):
        loaders.load(store, table(spark, sf, t), feed)
    return store.read("listings").select("property_id", "publish_date", "price")


# --- cubes: text -> cells -> rows of a table, loaded twice --------------------------------------


def _cube_text(spark: SparkSession, cells: DataFrame, dims: list[str]) -> DataFrame:
    """A JSON-stat cube of aggregated cells (columns named as the dimensions, and value): at most the product of its codes."""
    got = {tuple(r[:-1]): r[-1] for r in cells.select(*dims, "value").collect()}
    codes = [sorted({k[i] for k in got}) for i in range(len(dims))]
    body = {
        "id": dims,
        "size": [len(c) for c in codes],
        "value": [None if (v := got.get(k)) is None else float(v) for k in itertools.product(*codes)],
        "dimension": {d: {"label": d, "category": {"index": c, "label": {x: f"{x} all" for x in c}}} for d, c in zip(dims, codes, strict=True)},
    }
    return spark.createDataFrame([(json.dumps(body),)], "body string")


def _load_cube(spark: SparkSession, name: str, texts: list[DataFrame], columns: list[str]) -> DataFrame:
    store, feed = TableStore(spark, new_path(spark, "bronze")), loaders.cubes()[name]
    for t in texts:
        if not loaders.load_cube_text(store, t, "body", feed):
            raise RuntimeError(f"the {name} cube was not loaded")
    return store.read(feed.table).select(*columns)


_MONTHS = "strftime(o_orderdate, '%Y%m')"


@query(
    "q_cube_load_cpi",
    f"""
WITH c AS (SELECT o_orderpriority AS p, {_MONTHS} AS m, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT p, m FROM (SELECT DISTINCT p FROM c), (SELECT DISTINCT m FROM c))
SELECT 'CPA' AS statistic_code, 'CPA all' AS statistic_label, m AS time_period, CAST(m[:4] AS INTEGER) AS year, p AS commodity_code, p || ' all' AS commodity_label, CAST(n AS DOUBLE) AS value, 'cso.ie' AS source
FROM g LEFT JOIN c USING (p, m)
""",
)
def cube_load_cpi(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly cells of several commodities: every cell is a row, the second load of the same cube adds none."""
    o = table(spark, sf, "orders")
    cells = o.groupBy(F.lit("CPA").alias("STATISTIC"), F.date_format("o_orderdate", "yyyyMM").alias("TLIST(M1)"), F.col("o_orderpriority").alias("C01779V03424")).agg(F.count("*").alias("value"))
    text = _cube_text(spark, cells, ["STATISTIC", "TLIST(M1)", "C01779V03424"])
    return _load_cube(spark, "cpi", [text, text], ["statistic_code", "statistic_label", "time_period", "year", "commodity_code", "commodity_label", F.col("value").cast("double").alias("value"), "source"])


@query(
    "q_cube_load_population",
    """
WITH c AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS y, CAST(l_linenumber AS VARCHAR) AS a, l_returnflag AS s, count(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT y, a, s FROM (SELECT DISTINCT y FROM c), (SELECT DISTINCT a FROM c), (SELECT DISTINCT s FROM c))
SELECT y AS time_period, CAST(y AS INTEGER) AS year, a AS age_group_code, a || ' all' AS age_group_label, s AS sex_code, s || ' all' AS sex_label, CAST(n AS DOUBLE) AS value FROM g LEFT JOIN c USING (y, a, s)
""",
)
def cube_load_population(spark: SparkSession, sf: str) -> DataFrame:
    """A cube of four dimensions with empty cells, loaded as far as the year before the last, then whole: only the new year comes in."""
    item = table(spark, sf, "lineitem")
    dims = ["STATISTIC", "TLIST(A1)", "C02076V02508", "C02199V02655"]
    cells = item.groupBy(F.lit("PEA").alias(dims[0]), F.year("l_shipdate").cast("string").alias(dims[1]), F.col("l_linenumber").cast("string").alias(dims[2]), F.col("l_returnflag").alias(dims[3])).agg(F.count("*").alias("value"))
    last = item.agg(F.max(F.year("l_shipdate")).cast("string")).first()[0]
    # the cut cube still has every code of the other dimensions, so that both loads have the same cells for a year
    others = cells.where(F.col(f"`{dims[1]}`") == last).withColumn(dims[1], F.lit("1900")).withColumn("value", F.lit(None).cast("long"))
    first = _cube_text(spark, cells.where(F.col(f"`{dims[1]}`") != last).unionByName(others), dims)
    out = _load_cube(spark, "population", [first, _cube_text(spark, cells, dims)], ["time_period", "year", "age_group_code", "age_group_label", "sex_code", "sex_label", F.col("value").cast("double").alias("value")])
    return out.where("year > 1900")


@query(
    "q_cube_load_income",
    """
WITH o AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, n_name AS l, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
c AS (SELECT 'N' AS s, y, l, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT 'C', y, l, count(DISTINCT c_custkey) FROM o GROUP BY ALL),
g AS (SELECT s, y, l FROM (SELECT DISTINCT s FROM c), (SELECT DISTINCT y FROM c), (SELECT DISTINCT l FROM c))
SELECT s AS statistic_code, s || ' all' AS statistic_label, CAST(y AS INTEGER) AS year, l AS location_code, l || ' all' AS location_label, CAST(n AS DOUBLE) AS value FROM g LEFT JOIN c USING (s, y, l)
""",
)
def cube_load_income(spark: SparkSession, sf: str) -> DataFrame:
    """Two statistics for each place and year, keyed apart by their code."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    g = o.groupBy(F.year("o_orderdate").cast("string").alias("TLIST(A1)"), F.col("n_name").alias("C02196V02652")).agg(F.count("*").alias("N"), F.count_distinct("c_custkey").alias("C"))
    cells = g.select("`TLIST(A1)`", "C02196V02652", F.stack(F.lit(2), F.lit("N"), F.col("N"), F.lit("C"), F.col("C")).alias("STATISTIC", "value"))
    text = _cube_text(spark, cells, ["STATISTIC", "TLIST(A1)", "C02196V02652"])
    return _load_cube(spark, "income", [text, text], ["statistic_code", "statistic_label", "year", "location_code", "location_label", F.col("value").cast("double").alias("value")])


@query(
    "q_cube_load_rent",
    """
SELECT statistic_code, statistic_label, time_period, coalesce(year, TRY_CAST(trim(time_period)[:4] AS INTEGER)) AS year, bedrooms_label, property_type_label, location_label, unit, CAST(value AS DOUBLE) AS value FROM raw_cso_rent
""",
)
def cube_load_rent(spark: SparkSession, sf: str) -> DataFrame:
    """A cube as published in CSV, with its headers for people; repeated rows of a batch all come in, a second load adds none."""
    headers = {
        "statistic_code": "STATISTIC", "statistic_label": "STATISTIC Label", "time_period": "TLIST(A1)", "year": "Year", "bedrooms_label": "Number of Bedrooms",
        "property_type_label": "Property Type", "location_label": "Location", "unit": "UNIT", "value": "VALUE",
    }
    path = new_path(spark, "cube-csv")
    table(spark, sf, "raw_cso_rent").select(*[F.col(c).alias(h) for c, h in headers.items()]).write.option("nullValue", "\\N").option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)
    raw = spark.read.csv(path, header=True, nullValue="\\N", multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    store, feed = TableStore(spark, new_path(spark, "bronze")), loaders.cubes()["rent"]
    for _ in range(2):
        if not loaders.load_cube(store, raw, feed):
            raise RuntimeError("the rent cube was not loaded")
    return store.read(feed.table).select(*[F.col(c).cast("double").alias(c) if c == "value" else c for c in headers])
