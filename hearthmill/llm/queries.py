"""Named queries of the problems tagged llm (2, 3, 5, 8, 9, 10), with SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmill.llm import contamination, linkage, mapping, mixing, pagestyle, quantiles
from hearthmill.operators.relational import small
from hearthmill.session import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- 2: percentiles ---------------------------------------------------------------------------


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    month = F.date_format(F.trunc("scraped_at", "month"), "yyyyMMdd").cast("int")
    return table(spark, sf, "raw_daft_listings").where("price IS NOT NULL").select("source", month.alias("date_key"), "county", "price")


@_query(
    "p2_found",
    """
SELECT s.summary_key
FROM fact_market_summary s
JOIN dim_county c ON c.county_key = s.county_key
JOIN raw_daft_listings r ON r.source = s.source AND r.county = c.county_name AND r.price IS NOT NULL
  AND CAST(strftime(date_trunc('month', r.scraped_at), '%Y%m%d') AS INTEGER) = s.date_key
WHERE s.property_type_key IS NULL AND s.median_price IS NOT NULL
GROUP BY s.summary_key
HAVING count(*) >= 40 AND (count(*) FILTER (r.price <= s.median_price) < 0.4 * count(*) OR count(*) FILTER (r.price >= s.median_price) < 0.4 * count(*))
""",
)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches decide; only groups whose sketch leaves it open are counted exactly."""
    county = table(spark, sf, "dim_county").select("county_key", F.col("county_name").alias("county"))  # 26 counties, fixed
    rows = _priced(spark, sf).join(F.broadcast(county), "county").select("source", "date_key", "county_key", "price")
    on = ["source", "date_key", "county_key"]
    stated = table(spark, sf, "fact_market_summary").where("property_type_key IS NULL AND median_price IS NOT NULL").select("summary_key", *on, "median_price")
    suspects, _ = quantiles.percentile_suspects(stated, quantiles.sketches(rows, on, "price"), on, "median_price")
    suspects = materialize(suspects, "suspects")
    exact = (
        suspects.where("NOT sure")
        .join(rows, on)
        .groupBy("summary_key")
        .agg(F.count("*").alias("n"), F.count_if(F.col("price") <= F.col("median_price")).alias("low"), F.count_if(F.col("price") >= F.col("median_price")).alias("high"))
        .where("n >= 40 AND (low < 0.4 * n OR high < 0.4 * n)")
    )
    return suspects.where("sure").select("summary_key").unionByName(exact.select("summary_key"))


_PERCENTILES = {"p01": 0.01, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


@_query(
    "p2_percentiles",
    """
SELECT source, CAST(strftime(date_trunc('month', scraped_at), '%Y%m%d') AS INTEGER) AS date_key, county, count(*) AS n, """
    + ", ".join(f"quantile_disc(CAST(price AS DOUBLE), {p}) AS {n}" for n, p in _PERCENTILES.items())
    + " FROM raw_daft_listings WHERE price IS NOT NULL GROUP BY ALL",
)
def p2_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per feed, month and county as written; groups up to ``quantiles.capacity()`` rows are exact."""
    s = quantiles.sketches(_priced(spark, sf), ["source", "date_key", "county"], "price", high=None)
    return quantiles.quantile_columns(s, _PERCENTILES).drop("sketch")


@_query(
    "p2_rollup",
    "SELECT county, count(*) AS n, " + ", ".join(f"TRUE AS {c}_within" for c in _PERCENTILES) + " FROM raw_daft_listings WHERE price IS NOT NULL GROUP BY 1",
)
def p2_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of a county over all feeds and months, from their merged sketches, each held against an exact count: is its rank within its stated bound?"""
    rows = _priced(spark, sf)
    merged = quantiles.merge_sketches(quantiles.sketches(rows, ["source", "date_key", "county"], "price", high=None), ["county"])
    got = quantiles.error_columns(quantiles.quantile_columns(merged, _PERCENTILES).drop("sketch"), _PERCENTILES)
    q = materialize(got, "rollup")
    price = F.col("price").cast("double")
    counts = [x for c in _PERCENTILES for x in (F.count_if(price <= F.col(c)).alias(f"{c}_le"), F.count_if(price < F.col(c)).alias(f"{c}_lt"))]
    joined = rows.select(F.col("county").alias("at"), "price").join(q, F.col("at").eqNullSafe(F.col("county")))
    exact = joined.groupBy("county", "n", *[f"{c}_error" for c in _PERCENTILES]).agg(*counts)
    # the exact ranks of a value reach from the share below it to the share at or below it
    within = [((F.col(f"{c}_lt") / F.col("n") <= p + F.col(f"{c}_error")) & (F.col(f"{c}_le") / F.col("n") >= p - F.col(f"{c}_error"))).alias(f"{c}_within") for c, p in _PERCENTILES.items()]
    return exact.select("county", "n", *within)


# --- 3: new batches against all history -------------------------------------------------------


def _linkable(df: DataFrame, stage) -> DataFrame:
    compared = {"price": F.col("price").cast("double"), "county": F.lower(F.trim("county")), "title": F.lower(F.trim("title"))}
    return linkage.keyed(df, linkage.property_key(F.col("property_id")), linkage.event_ms(F.col("publish_date")), "id", stage, compared, written=F.col("property_id"))


_LINK_COLUMNS = ["id", "property_id", "publish_date", "price", "county", "title"]


def _history_linker(spark: SparkSession, sf: str) -> linkage.Linker:
    return linkage.Linker(spark, ["price", "county", "title"]).bootstrap(_linkable(table(spark, sf, "raw_daft_listings").select(*_LINK_COLUMNS), F.lit(0)))


_REPEATS_SQL = r"""
WITH r AS (
  SELECT id, 0 AS stage, property_id, publish_date FROM raw_daft_listings
  UNION ALL SELECT id, batch_no, property_id, publish_date FROM listing_arrivals),
k AS (
  SELECT id, stage,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(property_id), '０１２３４５６７８９', '0123456789'), '[\s,"]', '', 'g'), '^[^0-9]+', ''), '\.0+$', ''), '^0+', '') AS pid,
    CASE WHEN publish_date < 100000000000 THEN publish_date * 1000 ELSE publish_date END AS ms
  FROM r WHERE publish_date IS NOT NULL AND property_id IS NOT NULL),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY pid ORDER BY ms, stage, id) < 86400000 THEN 0 ELSE 1 END AS opens FROM k),
c AS (SELECT *, sum(opens) OVER (PARTITION BY pid ORDER BY ms, stage, id) AS part FROM g),
f AS (SELECT *, first_value(id) OVER (PARTITION BY pid, part ORDER BY stage, id) AS first_id FROM c)
SELECT first_id, id AS dup_id FROM f WHERE stage > 0 AND first_id <> id
"""


@_query("p3_found", _REPEATS_SQL)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The batches lie there together, so they are held against the history in one pass, in the order of batch_no and id."""
    linker = _history_linker(spark, sf)
    linker.accept(_linkable(table(spark, sf, "listing_arrivals").select("batch_no", *_LINK_COLUMNS), F.coalesce("batch_no", F.lit(0)) + 1))
    return linker.links().select("first_id", "dup_id")


@_query(
    "p3_links",
    _REPEATS_SQL.replace("SELECT first_id, id AS dup_id FROM f WHERE stage > 0 AND first_id <> id", "").rstrip()
    + """,
a AS (SELECT id, 0 AS batch_no, price FROM raw_daft_listings UNION ALL SELECT id, batch_no, price FROM listing_arrivals)
SELECT f.first_id, f.id AS dup_id, d.batch_no, coalesce(d.price = o.price, FALSE) AS same_price, TRUE AS likely
FROM f JOIN a d ON d.id = f.id JOIN a o ON o.id = f.first_id WHERE f.stage > 0 AND f.first_id <> f.id
""",
)
def p3_links(spark: SparkSession, sf: str) -> DataFrame:
    """The same repeats, batch after batch as they arrive, each by a linker that is opened from what the last one left.

    ``likely``: the learned score of row and first accepted row is in favour.
    """
    root = _history_linker(spark, sf).root
    arrivals = table(spark, sf, "listing_arrivals").select("batch_no", *_LINK_COLUMNS)
    for no in [r[0] for r in arrivals.select("batch_no").distinct().orderBy("batch_no").collect()]:  # one number for each batch
        batch = arrivals.where(F.col("batch_no") == no) if no is not None else arrivals.where("batch_no IS NULL")
        linkage.Linker.open(spark, root).accept(_linkable(batch, F.coalesce("batch_no", F.lit(0)) + 1))
    linked = linkage.Linker.open(spark, root).links()
    prices = table(spark, sf, "raw_daft_listings").select("id", F.col("price").alias("first_price")).unionByName(arrivals.select("id", F.col("price").alias("first_price")))
    out = linked.join(arrivals.select(F.col("id").alias("dup_id"), "batch_no", "price"), "dup_id").join(prices.withColumnRenamed("id", "first_id"), "first_id")
    return out.select("first_id", "dup_id", "batch_no", F.coalesce(F.col("price") == F.col("first_price"), F.lit(False)).alias("same_price"), (F.col("score") > 0).alias("likely"))


# --- 5: free-entered values -------------------------------------------------------------------


# fixed values: words in names of places
_RULES = mapping.PlaceRules(dropped=("ireland", "eire"))
#: bytes of mapped values up to which they are broadcast
_BROADCAST_BYTES = 8_000_000


def _typed_places(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(rows, mapping): the typed values of both tables, and the entry of each distinct one."""
    ref = table(spark, sf, "ref_location")
    daft = table(spark, sf, "raw_daft_listings").select(F.lit("daft").alias("src"), "id", F.col("county").alias("value"), F.lit(True).alias("county_only"))
    cso = table(spark, sf, "raw_cso_rent").select(F.lit("cso").alias("src"), "id", F.col("location_label").alias("value"), F.lit(False).alias("county_only"))
    rows = daft.unionByName(cso).where("trim(value) <> ''")
    exact = ref.select(F.col("canonical_name").alias("value")).distinct()
    rows = rows.join(small(exact, 10_000), "value", "left_anti")
    return rows, materialize(mapping.map_places(rows, ref, _RULES), "places")


@_query("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows, places = _typed_places(spark, sf)
    places = places.select("src", "value", "location_id")
    if places.agg(F.coalesce(F.sum(F.octet_length("value") + 32), F.lit(0)).alias("n")).first().n <= _BROADCAST_BYTES:  # else Spark joins by value and splits the hot ones
        places = F.broadcast(places)
    return rows.join(places, ["src", "value"]).select("src", "id", "location_id")


@_query("p5_unmatched")
def p5_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that mean no entry, with how many rows hold each."""
    rows, places = _typed_places(spark, sf)
    counts = rows.groupBy("src", "value").agg(F.count("*").alias("n"))
    return counts.join(places.where("location_id = 0"), ["src", "value"]).select("src", "value", "n")


# --- 8: leaked evaluation texts ---------------------------------------------------------------


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return contamination.leaks(docs, table(spark, sf, "eval_items").select("item_id", "text"))


@_query("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


@_query("p8_cleaned")
def p8_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus with every leaked passage cut out of its text."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return contamination.without_leaks(docs, table(spark, sf, "eval_items").select("item_id", "text"))


# --- 9: mixing sources ------------------------------------------------------------------------


@_query("p9_mix")
def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "text"), table(spark, sf, "mix_targets"))[0]


@_query("p9_shares")
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "text"), table(spark, sf, "mix_targets"))[1]


# --- 10: spam pages ---------------------------------------------------------------------------


@_query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return pagestyle.odd_pages(table(spark, sf, "documents").select("doc_id", "text")).where("odd_share > 0.5").select("doc_id")
