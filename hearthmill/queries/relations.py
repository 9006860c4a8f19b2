"""Queries of the relational operators: projections, filters, joins, aggregates, windows, sorts, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthmill.functions import numbers as N
from hearthmill.operators import geo, rules
from hearthmill.operators import relational as R
from hearthmill.queries.base import Named
from hearthmill.session import table

query = Named()
QUERIES, SQL = query.QUERIES, query.SQL



def _mean(money: str):
    """Mean of an amount in whole cents: the sum is exact, so engines agree on every digit."""
    cents = F.sum(F.round(F.col(money) * 100).cast("long")).cast("double")
    return cents / F.count(money) / 100


# --- flagship ---------------------------------------------------------------------------------


@query(
    "q_value_by_nation",
    """
SELECT n_name AS nation, count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(o_totalprice) / 100 AS avg_price,
       round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median_price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""",
)
def value_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(R.small(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("n_name").alias("nation"))
        .agg(F.count("*").alias("n_orders"), _mean("o_totalprice").alias("avg_price"), F.round(F.percentile("o_totalprice", 0.5), 4).alias("median_price"))
        .orderBy(F.desc("avg_price"))
    )


# --- projections and conditions ---------------------------------------------------------------


@query(
    "q_categories",
    """
SELECT p_partkey,
  CASE WHEN p_type ILIKE '%promo%' THEN 'Promotion' WHEN p_type ILIKE '%economy%' THEN 'Economy' WHEN p_type ILIKE '%o%' THEN 'With O' ELSE lower(trim(p_type)) END AS category,
  CASE WHEN p_retailprice < 1000 THEN 'Low' WHEN p_retailprice < 1500 THEN 'Middle' ELSE 'High' END AS price_band,
  CASE WHEN p_size = 0 THEN 'None' WHEN p_size <= 10 THEN 'Small' WHEN p_size <= 30 THEN 'Medium' ELSE 'Large' END AS size_band,
  CASE WHEN p_size > 0 THEN round(p_retailprice / p_size, 5) END AS price_per_size,
  30 * (CASE WHEN p_retailprice BETWEEN 950 AND 1500 THEN 1 ELSE 0 END) + 20 * (CASE WHEN length(p_name) > 10 THEN 1 ELSE 0 END)
     + 20 * (CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#13') THEN 1 ELSE 0 END) AS score,
  CASE WHEN p_retailprice < 950 OR p_retailprice > 1950 THEN 1 ELSE 0 END AS is_outlier
FROM part
""",
)
def categories(spark: SparkSession, sf: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        rules.like_rules(F.col("p_type"), [("%promo%", "Promotion"), ("%economy%", "Economy"), ("%o%", "With O")], F.lower(F.trim("p_type"))).alias("category"),
        rules.bands(price, [(1000, "Low"), (1500, "Middle")], "High", null="High").alias("price_band"),
        rules.first_match([(size == 0, "None"), (size <= 10, "Small"), (size <= 30, "Medium")], "Large").alias("size_band"),
        F.when(size > 0, F.round(price / size, 5)).alias("price_per_size"),
        rules.score([(price.between(950, 1500), 30), (F.length("p_name") > 10, 20), (F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#13"), 20)]).alias("score"),
        rules.flag((price < 950) | (price > 1950)).alias("is_outlier"),
    )


@query(
    "q_label_rules",
    r"""
SELECT id, CASE WHEN location_code IS NULL THEN 'Unknown' WHEN regexp_matches(location_code, '^\d+$') THEN NULL ELSE location_code END AS location_clean,
  CASE WHEN lower(bedrooms_label) LIKE '%one%' OR lower(bedrooms_label) LIKE '%1 bed%' THEN '1' WHEN lower(bedrooms_label) LIKE '%two%' OR lower(bedrooms_label) LIKE '%2 bed%' THEN '2' ELSE bedrooms_label END AS beds,
  CASE WHEN lower(unit) LIKE '%thousand%' THEN CAST(value AS DOUBLE) * 1000 WHEN lower(unit) LIKE '%million%' THEN CAST(value AS DOUBLE) * 1000000 ELSE CAST(value AS DOUBLE) END AS scaled,
  coalesce(nullif(trim(property_type_label), ''), 'none') AS kind,
  CASE WHEN value IS NULL THEN 1 ELSE 0 END AS missing_value
FROM raw_cso_rent
""",
)
def label_rules(spark: SparkSession, sf: str) -> DataFrame:
    code, beds, value = F.col("location_code"), F.lower("bedrooms_label"), F.col("value").cast("double")
    return table(spark, sf, "raw_cso_rent").select(
        "id",
        rules.first_match([(code.isNull(), "Unknown"), (code.rlike(r"^\d+$"), F.lit(None).cast("string"))], code).alias("location_clean"),
        rules.first_match([(beds.like("%one%") | beds.like("%1 bed%"), "1"), (beds.like("%two%") | beds.like("%2 bed%"), "2")], F.col("bedrooms_label")).alias("beds"),
        rules.scaled_by_unit(value, F.col("unit"), [("thousand", 1000), ("million", 1_000_000)]).alias("scaled"),
        F.coalesce(rules.blank_to_null(F.col("property_type_label")), F.lit("none")).alias("kind"),
        rules.flag(F.col("value").isNull()).alias("missing_value"),
    )


_BOXES = [("Dublin", 53.2, 53.5, -6.5, -6.0), ("Cork", 51.5, 52.2, -10.0, -8.0), ("Galway", 53.0, 53.6, -10.0, -8.0), ("Limerick", 52.4, 52.8, -9.5, -8.3), ("Kildare", 53.0, 53.4, -7.2, -6.5), ("Meath", 53.4, 53.9, -7.2, -6.2)]


@query(
    "q_point_in_box",
    "SELECT listing_key, CASE "
    + " ".join(f"WHEN latitude BETWEEN {a} AND {b} AND longitude BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in _BOXES)
    + " ELSE 'Unknown' END AS region, CASE WHEN latitude IS NULL OR longitude IS NULL THEN NULL ELSE CAST(floor(CAST(latitude AS DOUBLE) * 100) AS BIGINT) || '_' || CAST(floor(CAST(longitude AS DOUBLE) * 100) AS BIGINT) END AS grid"
    " FROM fact_rental_listings",
)
def point_in_box(spark: SparkSession, sf: str) -> DataFrame:
    """First box (inclusive, in order) that holds a point, through the cell cover; grid number of the point."""
    df = table(spark, sf, "fact_rental_listings").select("listing_key", "latitude", "longitude")
    grid = F.concat(N.nth_of_grid(F.col("latitude")).cast("string"), F.lit("_"), N.nth_of_grid(F.col("longitude")).cast("string"))
    return geo.points_in_boxes(df, "latitude", "longitude", _BOXES, default="Unknown").select("listing_key", "region", grid.alias("grid"))


@query(
    "q_set_rules",
    """
SELECT county_key, county_name,
  CASE WHEN county_name IN ('Dublin', 'Cork', 'Galway') THEN 'Urban' WHEN county_name = 'Unknown' THEN 'Unknown' ELSE 'Rural' END AS kind,
  county_name IN ('Kildare', 'Meath', 'Wicklow', 'Louth') AS is_belt
FROM dim_county
""",
)
def set_rules(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("county_name")
    return table(spark, sf, "dim_county").select(
        "county_key", c, rules.in_sets(c, [(["Dublin", "Cork", "Galway"], "Urban"), (["Unknown"], "Unknown")], "Rural").alias("kind"), c.isin("Kildare", "Meath", "Wicklow", "Louth").alias("is_belt")
    )


@query(
    "q_filters",
    """
SELECT id, property_type, bedrooms FROM raw_daft_listings
WHERE price > 0 AND price < 50000 AND scraped_at IS NOT NULL AND bedrooms BETWEEN 1 AND 3 AND property_type NOT IN ('Studio', 'Room')
  AND title ILIKE '%road%' AND regexp_matches(property_id, '^[0-9]+$') AND (latitude IS NOT NULL OR county IS NOT NULL) AND bedrooms IS NOT DISTINCT FROM bedrooms
""",
)
def filters(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "raw_daft_listings")
        .where((F.col("price") > 0) & (F.col("price") < 50000) & F.col("scraped_at").isNotNull())
        .where(F.col("bedrooms").between(1, 3) & ~F.col("property_type").isin("Studio", "Room"))
        .where(F.col("title").ilike("%road%") & F.col("property_id").rlike("^[0-9]+$"))
        .where((F.col("latitude").isNotNull() | F.col("county").isNotNull()) & F.col("bedrooms").eqNullSafe(F.col("bedrooms")))
        .select("id", "property_type", "bedrooms")
    )


@query(
    "q_relative_window",
    """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY
   OR o_orderdate BETWEEN TIMESTAMP '2001-08-01' - INTERVAL 15 MONTH AND TIMESTAMP '2001-08-01' - INTERVAL 12 MONTH
""",
)
def relative_window(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit("2001-08-01").cast("timestamp_ntz")
    d = F.col("o_orderdate")
    recent = d >= as_of - F.expr("interval 90 days")
    year_ago = d.between(as_of - F.expr("interval 15 months"), as_of - F.expr("interval 12 months"))
    return table(spark, sf, "orders").where(recent | year_ago).select("o_orderkey", "o_orderdate")


# --- joins ------------------------------------------------------------------------------------


@query("q_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return R.anti_null_safe(table(spark, sf, "customer").select("c_custkey", "c_name"), big, ["c_custkey"])


@query("q_semi", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_suppkey) IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def semi(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    return R.semi(li, li.where("l_returnflag = 'R' AND l_quantity > 45"), ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "q_full_outer",
    """
WITH a AS (SELECT year(o_orderdate) AS y, 'F' AS s, count(*) AS n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT year(l_shipdate) AS y, l_linestatus AS s, count(*) AS n_lines FROM lineitem GROUP BY 1, 2),
c AS (SELECT year(ts) AS y, 'O' AS s, count(*) AS n_events FROM events GROUP BY 1)
SELECT CAST(coalesce(a.y, b.y, c.y) AS INTEGER) AS y, coalesce(a.s, b.s, c.s) AS s, n_f, n_lines, n_events
FROM a FULL JOIN b ON a.y = b.y AND a.s = b.s FULL JOIN c ON coalesce(a.y, b.y) = c.y AND coalesce(a.s, b.s) = c.s
""",
)
def full_outer(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.year("o_orderdate").alias("y"), F.lit("F").alias("s")).agg(F.count("*").alias("n_f"))
    b = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("y"), F.col("l_linestatus").alias("s")).agg(F.count("*").alias("n_lines"))
    c = table(spark, sf, "events").groupBy(F.year("ts").alias("y"), F.lit("O").alias("s")).agg(F.count("*").alias("n_events"))
    return R.full_merge([a, b, c], ["y", "s"])


@query(
    "q_lookup_name",
    """
SELECT r.id, (SELECT min(county_key) FROM dim_county c WHERE lower(c.county_name) = lower(r.county)) AS county_key
FROM raw_daft_listings r
""",
)
def lookup_name(spark: SparkSession, sf: str) -> DataFrame:
    return R.lookup_name(table(spark, sf, "raw_daft_listings").select("id", "county"), "county", table(spark, sf, "dim_county"), "county_name", "county_key", "county_key").select("id", "county_key")


@query(
    "q_fan_out",
    """
SELECT r_name, n_name, count(*) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY 1, 2
""",
)
def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Left joins that repeat rows; the right side's own predicate stays in the join."""
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    s = table(spark, sf, "supplier").where("s_acctbal > 0").select("s_nationkey")
    j = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


@query("q_constant_row", "SELECT n_name, (SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(o_totalprice) / 100 FROM orders) AS overall, (SELECT r_name FROM region WHERE r_regionkey = 0) AS first_region FROM nation")
def constant_row(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "orders").agg(_mean("o_totalprice").alias("overall"))
    first = table(spark, sf, "region").where("r_regionkey = 0").select(F.col("r_name").alias("first_region"))
    return R.with_constant_row(R.with_constant_row(table(spark, sf, "nation").select("n_name"), one), first)


@query("q_salted_join", "SELECT seller_id, count(*) AS n, CAST(sum(d.n_chars) AS BIGINT) AS chars FROM raw_daft_listings r JOIN documents d USING (property_id, seller_id) GROUP BY seller_id")
def salted_join(spark: SparkSession, sf: str) -> DataFrame:
    """Join on property and seller, of which no pair is hot: the path without salts; see q_salted_hot."""
    r = table(spark, sf, "raw_daft_listings").select("property_id", "seller_id")
    d = table(spark, sf, "documents").select("property_id", "seller_id", "n_chars")
    return R.salted_join(r, d, ["property_id", "seller_id"]).groupBy("seller_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("q_salted_hot", "SELECT r.id, seller_id, CAST(d.chars AS BIGINT) AS chars FROM raw_daft_listings r JOIN (SELECT seller_id, sum(n_chars) AS chars FROM documents GROUP BY seller_id) d USING (seller_id)")
def salted_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Join with one row for each seller; the rows of a seller in a tenth of the listings are spread over salts."""
    r = table(spark, sf, "raw_daft_listings").select("id", "seller_id")
    d = table(spark, sf, "documents").groupBy("seller_id").agg(F.sum("n_chars").alias("chars"))
    return R.salted_join(r, d, ["seller_id"]).select("id", "seller_id", "chars")


# --- aggregates -------------------------------------------------------------------------------


@query(
    "q_market_summary",
    """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_mktsegment AS segment, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(o_totalprice) / 100 AS avg_price,
  min(o_totalprice) AS min_price, max(o_totalprice) AS max_price, round(stddev_samp(o_totalprice), 3) AS sd_price,
  round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median_price,
  count(*) FILTER (o_orderstatus = 'F') AS n_f, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS n_urgent,
  round(100.0 * count(*) FILTER (o_totalprice > 200000) / nullif(count(*), 0), 4) AS pct_big
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2
""",
)
def market_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    p = F.col("o_totalprice")
    return o.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("n"),
        _mean("o_totalprice").alias("avg_price"),
        F.min(p).alias("min_price"),
        F.max(p).alias("max_price"),
        F.round(F.stddev_samp(p), 3).alias("sd_price"),
        F.round(F.percentile(p, 0.5), 4).alias("median_price"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("n_urgent"),
        F.round(R.share_where(p > 200000), 4).alias("pct_big"),
    )


@query(
    "q_percentiles",
    "SELECT l_returnflag, "
    + ", ".join(f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
    + " FROM lineitem GROUP BY 1",
)
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    names = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    got = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*R.exact_percentiles("l_extendedprice", names))
    return got.select("l_returnflag", *[F.round(n, 4).alias(n) for n in names])


@query(
    "q_activity",
    """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(CAST(avg(value) AS DOUBLE), 9) AS avg_value, count(*) FILTER (value > 50) AS n_large, count(*) FILTER (user_id <= 10) AS n_first_users FROM events GROUP BY 1, 2
""",
)
def activity(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.col("ts").cast("date").alias("day"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("avg_value"), F.count_if(F.col("value") > 50).alias("n_large"), F.count_if(F.col("user_id") <= 10).alias("n_first_users"))
    )


@query(
    "q_pivot_max",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, max(o_totalprice) FILTER (o_orderpriority ILIKE '%urgent%') AS urgent, max(o_totalprice) FILTER (o_orderpriority ILIKE '%low%' OR o_orderpriority ILIKE '%not%') AS low, max(o_totalprice) FILTER (o_orderpriority ILIKE '%-%') AS any_priority FROM orders GROUP BY 1, 2",
)
def pivot_max(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return R.pivot_max(o, ["y", "o_orderstatus"], "o_orderpriority", "o_totalprice", {"urgent": ["%urgent%"], "low": ["%low%", "%not%"], "any_priority": ["%-%"]})


@query(
    "q_average_of_averages",
    "SELECT n_regionkey, CAST(sum(n) AS BIGINT) AS n, round(CAST(avg(a) AS DOUBLE), 6) AS avg_of_avg, bool_or(a > 5000) AS any_rich, min(n_name) AS any_name FROM (SELECT n_regionkey, n_name, count(*) AS n, avg(c_acctbal) AS a FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) GROUP BY 1",
)
def average_of_averages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(R.small(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    g = c.groupBy("n_regionkey", "n_name").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("a"))
    return g.groupBy("n_regionkey").agg(F.sum("n").alias("n"), F.round(F.avg("a"), 6).alias("avg_of_avg"), F.bool_or(F.col("a") > 5000).alias("any_rich"), F.min("n_name").alias("any_name"))


@query(
    "q_global_aggregate",
    "SELECT count(*) AS n, max(o_orderdate) AS latest, count(*) FILTER (o_totalprice IS NULL) AS n_null, round(CAST(avg(CASE WHEN o_orderstatus = 'F' THEN 4 WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END) AS DOUBLE), 6) AS avg_score FROM orders",
)
def global_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").agg(
        F.count("*").alias("n"), F.max("o_orderdate").alias("latest"), F.count_if(F.col("o_totalprice").isNull()).alias("n_null"), F.round(F.avg(rules.first_match([(s == "F", 4), (s == "O", 2)], 1)), 6).alias("avg_score")
    )


@query("q_keep_latest", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def keep_latest(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return R.keep_latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("q_keep_first_null_key", "SELECT daft_shortcode, id FROM (SELECT *, row_number() OVER (PARTITION BY daft_shortcode ORDER BY scraped_at DESC NULLS LAST, id) AS rn FROM raw_daft_listings) WHERE rn = 1")
def keep_first_null_key(spark: SparkSession, sf: str) -> DataFrame:
    """Null keys are one group, as in DISTINCT ON."""
    r = table(spark, sf, "raw_daft_listings").select("daft_shortcode", "id", "scraped_at")
    return R.keep_first(r, ["daft_shortcode"], [F.col("scraped_at").desc_nulls_last(), F.col("id")]).select("daft_shortcode", "id")


@query(
    "q_listagg",
    "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rn FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)) WHERE rn <= 3 GROUP BY 1",
)
def listagg(spark: SparkSession, sf: str) -> DataFrame:
    return R.distinct_list(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "priorities", limit=3)


# --- windows, sorts ---------------------------------------------------------------------------


@query(
    "q_yoy",
    """
WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus AS s, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(o_totalprice) / 100 AS v FROM orders GROUP BY 1, 2)
SELECT y, s, v, lag(v) OVER w AS yoy_before, round(v - lag(v) OVER w, 4) AS yoy_change, round((v - lag(v) OVER w) / nullif(lag(v) OVER w, 0) * 100, 4) AS yoy_pct FROM y WINDOW w AS (PARTITION BY s ORDER BY y)
""",
)
def yoy(spark: SparkSession, sf: str) -> DataFrame:
    y = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("s")).agg(_mean("o_totalprice").alias("v"))
    return R.period_change(y, ["s"], "y", "v", {"yoy": 1}).withColumn("yoy_change", F.round("yoy_change", 4)).withColumn("yoy_pct", F.round("yoy_pct", 4))


@query(
    "q_mom_yoy_trend",
    """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS p, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(o_totalprice) / 100 AS v FROM orders GROUP BY 1, 2),
l AS (SELECT *, lag(v) OVER w AS a, lag(v, 12) OVER w AS b FROM m WINDOW w AS (PARTITION BY p ORDER BY month)),
q AS (SELECT *, (v - a) / nullif(a, 0) * 100 AS mp, (v - b) / nullif(b, 0) * 100 AS yp FROM l)
SELECT month, p, v, round(mp, 4) AS mom_pct, round(yp, 4) AS yoy_pct, CASE WHEN mp > 5 THEN 'Strong Up' WHEN mp < -5 THEN 'Strong Down' WHEN mp > 1 THEN 'Up' WHEN mp < -1 THEN 'Down' ELSE 'Stable' END AS trend FROM q
""",
)
def mom_yoy_trend(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("o_orderpriority").alias("p")).agg(_mean("o_totalprice").alias("v"))
    c = R.period_change(m, ["p"], "month", "v", {"mom": 1, "yoy": 12})
    return c.select("month", "p", "v", F.round("mom_pct", 4).alias("mom_pct"), F.round("yoy_pct", 4).alias("yoy_pct"), rules.trend(F.col("mom_pct"), [(5, "Strong"), (1, "")], "Stable").alias("trend"))


@query("q_lag_of_average", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(o_totalprice) / 100 AS v, lag(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(o_totalprice) / 100) OVER (ORDER BY year(o_orderdate)) AS before FROM orders GROUP BY year(o_orderdate)")
def lag_of_average(spark: SparkSession, sf: str) -> DataFrame:
    """One short series without keys: a row for each year, so one task is enough."""
    y = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(_mean("o_totalprice").alias("v"))
    return y.select("y", "v", F.lag("v").over(W.orderBy("y")).alias("before"))


@query("q_row_number_dim", "SELECT name, row_number() OVER (ORDER BY name = 'Unknown', name) AS key FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT 'Unknown')")
def row_number_dim(spark: SparkSession, sf: str) -> DataFrame:
    names = R.union_distinct([table(spark, sf, "nation").select(F.col("n_name").alias("name")), table(spark, sf, "region").select("r_name"), spark.range(1).select(F.lit("Unknown"))])
    return R.numbered(names.withColumn("last", F.col("name") == "Unknown"), [F.col("last"), F.col("name")]).select("name", F.col("key").cast("long").alias("key"))


@query("q_top_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_n(table(spark, sf, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal")


@query("q_at_latest", "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)")
def at_latest(spark: SparkSession, sf: str) -> DataFrame:
    return R.at_latest(table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date")), "day").select("o_orderkey", "o_custkey")


@query("q_top_report", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def top_report(spark: SparkSession, sf: str) -> DataFrame:
    """A top-20 report: the limit is its feature."""
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(20)


@query(
    "q_kpi_dashboard",
    """
WITH m AS (
  SELECT c_nationkey AS k, date_trunc('month', o_orderdate) AS month, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(o_totalprice) / 100 AS v
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
l AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY month) AS before FROM m)
SELECT n_name AS nation, l.n, l.v, round((l.v - before) / nullif(before, 0) * 100, 4) AS change_pct, s.suppliers
FROM l JOIN (SELECT max(month) AS month FROM m) x ON l.month = x.month JOIN nation ON n_nationkey = l.k
LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s ON s.s_nationkey = l.k
""",
)
def kpi_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """Latest month of each nation with its change and a side measure pre-filtered before a left join."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), F.col("c_custkey") == F.col("o_custkey"))
    m = o.groupBy("k", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").alias("n"), _mean("o_totalprice").alias("v"))
    latest = R.at_latest(R.period_change(m, ["k"], "month", "v", {"m": 1}), "month")
    side = table(spark, sf, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    named = latest.join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation")), "k")
    return named.join(side, "k", "left").select("nation", "n", "v", F.round("m_pct", 4).alias("change_pct"), "suppliers")


@query(
    "q_affordability",
    """
WITH q AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(o_totalprice) / 100 AS price FROM orders GROUP BY 1),
y AS (SELECT CAST(1995 + c_nationkey % 5 AS INTEGER) AS y, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(c_acctbal) / 100 AS income FROM customer WHERE c_acctbal > 0 GROUP BY 1),
r AS (SELECT quarter, price, income, price * 12 / nullif(income * 1000, 0) * 100 AS ratio FROM q LEFT JOIN y ON y.y = year(quarter))
SELECT quarter, price, income, round(ratio, 4) AS ratio, CASE WHEN ratio < 25 THEN 'A' WHEN ratio < 30 THEN 'B' WHEN ratio < 40 THEN 'C' ELSE 'D' END AS class FROM r
""",
)
def affordability(spark: SparkSession, sf: str) -> DataFrame:
    """Join on an expression, ratio and class; a null ratio falls to the last class."""
    q = table(spark, sf, "orders").groupBy(F.date_trunc("quarter", "o_orderdate").cast("date").alias("quarter")).agg(_mean("o_totalprice").alias("price"))
    y = table(spark, sf, "customer").where("c_acctbal > 0").groupBy((F.lit(1995) + F.col("c_nationkey") % 5).cast("int").alias("y")).agg(_mean("c_acctbal").alias("income"))
    r = q.join(y, F.year("quarter") == F.col("y"), "left").withColumn("r", N.ratio(F.col("price") * 12, F.col("income") * 1000) * 100)
    return r.select("quarter", "price", "income", F.round("r", 4).alias("ratio"), rules.bands(F.col("r"), [(25, "A"), (30, "B"), (40, "C")], "D", null="D").alias("class"))


# --- set operations ---------------------------------------------------------------------------


@query("q_except", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 10")
def except_(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).subtract(table(spark, sf, "lineitem").where("l_quantity > 10").select("l_orderkey"))


@query("q_intersect", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'")
def intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")).intersect(table(spark, sf, "lineitem").where("l_returnflag = 'A'").select("l_orderkey"))


@query(
    "q_quality_union",
    """
SELECT 'listings' AS name, count(*) AS n, count(*) FILTER (price IS NULL) AS n_null, count(*) FILTER (price < 500 OR price > 10000) AS n_outlier, round(100.0 * count(*) FILTER (county IS NULL) / nullif(count(*), 0), 4) AS pct_null, max(scraped_at) AS latest FROM raw_daft_listings
UNION ALL
SELECT 'rents', count(*), count(*) FILTER (value IS NULL), count(*) FILTER (value < 500 OR value > 10000), round(100.0 * count(*) FILTER (location_label IS NULL) / nullif(count(*), 0), 4), max(date_fetched) FROM raw_cso_rent
""",
)
def quality_union(spark: SparkSession, sf: str) -> DataFrame:
    def part(name: str, df: DataFrame, value: str, label: str, at: str) -> DataFrame:
        v = F.col(value)
        return df.agg(
            F.lit(name).alias("name"), F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if((v < 500) | (v > 10000)).alias("n_outlier"), F.round(R.share_where(F.col(label).isNull()), 4).alias("pct_null"), F.max(at).alias("latest")
        )

    return R.union_all([part("listings", table(spark, sf, "raw_daft_listings"), "price", "county", "scraped_at"), part("rents", table(spark, sf, "raw_cso_rent"), "value", "location_label", "date_fetched")])
