"""Queries of table maintenance, snapshots, data tests, models and streaming."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmill.operators import relational as R
from hearthmill.plans import data_tests as DT
from hearthmill.plans import snapshot, strategies
from hearthmill.plans.registry import Registry
from hearthmill.plans.store import TableStore
from hearthmill.queries.base import Named
from hearthmill.session import new_path, table
from hearthmill.streaming import ingest

query = Named()
QUERIES, SQL = query.QUERIES, query.SQL

_CUT = "2000-01-01"
_LATE = "2000-07-01"


def _target_and_batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders up to a date, and a batch of later ones of which some were there already, at another price."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    target = o.where(F.col("o_orderdate") < F.lit(_LATE).cast("timestamp_ntz"))
    return target, o.where(F.col("o_orderdate") >= F.lit(_CUT).cast("timestamp_ntz")).withColumn("o_totalprice", F.col("o_totalprice") + 1)


_TB = f"WITH t AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '{_LATE}'), b AS (SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '{_CUT}') "


@query("q_incremental_append", _TB + "SELECT * FROM t UNION ALL SELECT * FROM b")
def incremental_append(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.append(*_target_and_batch(spark, sf))


@query("q_incremental_delete_insert", _TB + "SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b")
def incremental_delete_insert(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.delete_insert(*_target_and_batch(spark, sf), ["o_orderkey"])


@query("q_incremental_merge", _TB + "SELECT coalesce(t.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(t.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(b.o_totalprice, t.o_totalprice) AS o_totalprice, coalesce(t.o_orderdate, b.o_orderdate) AS o_orderdate FROM t FULL JOIN b USING (o_orderkey)")
def incremental_merge(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.merge(*_target_and_batch(spark, sf), ["o_orderkey"], update=["o_totalprice"])


@query("q_incremental_overwrite", _TB + "SELECT * FROM t WHERE NOT (o_orderdate >= TIMESTAMP '2000-01-01') UNION ALL SELECT * FROM b")
def incremental_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    t, b = _target_and_batch(spark, sf)
    return strategies.insert_overwrite(t, b, F.col("o_orderdate") >= F.lit(_CUT).cast("timestamp_ntz"))


@query("q_incremental_partitions", _TB + "SELECT * FROM t WHERE year(o_orderdate) * 100 + month(o_orderdate) NOT IN (SELECT year(o_orderdate) * 100 + month(o_orderdate) FROM b) UNION ALL SELECT * FROM b")
def incremental_partitions(spark: SparkSession, sf: str) -> DataFrame:
    t, b = _target_and_batch(spark, sf)
    month = F.trunc("o_orderdate", "month")
    return strategies.overwrite_partitions(t.withColumn("m", month), b.withColumn("m", month), ["m"]).drop("m")


@query("q_incremental_microbatch", _TB + "SELECT coalesce(b.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, t.o_orderstatus) AS o_orderstatus, coalesce(b.o_totalprice, t.o_totalprice) AS o_totalprice, coalesce(b.o_orderdate, t.o_orderdate) AS o_orderdate FROM t FULL JOIN (SELECT * FROM b WHERE o_orderdate < TIMESTAMP '2000-03-01') b USING (o_orderkey)")
def incremental_microbatch(spark: SparkSession, sf: str) -> DataFrame:
    t, b = _target_and_batch(spark, sf)
    return strategies.microbatch(t, b, "o_orderdate", [(date(2000, 1, 1), date(2000, 2, 1)), (date(2000, 2, 1), date(2000, 3, 1))], ["o_orderkey"])


@query("q_insert_ignore", _TB + "SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.insert_ignore(*_target_and_batch(spark, sf), ["o_orderkey"])


@query("q_high_water", _TB + "SELECT b.* FROM b WHERE o_orderdate > (SELECT max(o_orderdate) FROM t)")
def high_water(spark: SparkSession, sf: str) -> DataFrame:
    t, b = _target_and_batch(spark, sf)
    return strategies.newer_than(b, "o_orderdate", t)


@query("q_schema_sync", "SELECT n_nationkey, CAST(NULL AS INTEGER) AS extra FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, 1 FROM nation WHERE n_regionkey = 1")
def schema_sync(spark: SparkSession, sf: str) -> DataFrame:
    """A batch that lost a column and brings a new one: the target follows."""
    n = table(spark, sf, "nation")
    t, b = strategies.sync_schema(n.where("n_regionkey = 0"), n.where("n_regionkey = 1").select("n_nationkey", F.lit(1).alias("extra")), "sync_all_columns")
    return strategies.append(t, b)


# --- snapshots --------------------------------------------------------------------------------

_V1, _V2 = "TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-02-01 00:00:00'"


def _customer_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers, and a month later: every tenth richer and stamped later, every seventh gone, some new."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal").withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    k = F.col("c_custkey")
    later = c.where(k % 7 != 0).withColumn("at", F.when(k % 10 == 0, F.lit("2024-02-01").cast("timestamp_ntz")).otherwise(F.col("at"))).withColumn("c_acctbal", F.when(k % 10 == 0, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")))
    return c.where(k % 13 != 0), later


@query(
    "q_snapshot_timestamp",
    f"""
WITH c AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), a AS (SELECT * FROM c WHERE k % 13 <> 0)
SELECT k AS c_custkey, v AS c_acctbal, {_V1} AS valid_from, CASE WHEN k % 10 = 0 OR k % 7 = 0 THEN {_V2} END AS valid_to, FALSE AS is_deleted FROM a
UNION ALL SELECT k, v + 100, {_V2}, NULL, FALSE FROM a WHERE k % 10 = 0 AND k % 7 <> 0
UNION ALL SELECT k, CASE WHEN k % 10 = 0 THEN v + 100 ELSE v END, CASE WHEN k % 10 = 0 THEN {_V2} ELSE {_V1} END, NULL, FALSE FROM c WHERE k % 13 = 0 AND k % 7 <> 0
""",
)
def snapshot_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _customer_versions(spark, sf)
    s = snapshot.first(a, ["c_custkey"], F.col("at"))
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    return snapshot.take(s, b, ["c_custkey"], now, updated_at="at", hard_deletes="invalidate").select("c_custkey", "c_acctbal", "valid_from", "valid_to", "is_deleted")


@query(
    "q_snapshot_check",
    f"""
WITH c AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), a AS (SELECT * FROM c WHERE k % 13 <> 0)
SELECT k AS c_custkey, v AS c_acctbal, {_V1} AS valid_from, CASE WHEN k % 10 = 0 OR k % 7 = 0 THEN {_V2} END AS valid_to, FALSE AS is_deleted FROM a
UNION ALL SELECT k, v + 100, {_V2}, NULL, FALSE FROM a WHERE k % 10 = 0 AND k % 7 <> 0
UNION ALL SELECT k, CASE WHEN k % 10 = 0 THEN v + 100 ELSE v END, {_V2}, NULL, FALSE FROM c WHERE k % 13 = 0 AND k % 7 <> 0
UNION ALL SELECT k, v, {_V2}, NULL, TRUE FROM a WHERE k % 7 = 0
""",
)
def snapshot_check(spark: SparkSession, sf: str) -> DataFrame:
    """Check strategy with deletion records; a second look at the same source changes nothing."""
    a, b = _customer_versions(spark, sf)
    t0, now = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-02-01").cast("timestamp_ntz")
    s = snapshot.first(a.drop("at"), ["c_custkey"], t0)
    once = snapshot.take(s, b.drop("at"), ["c_custkey"], now, check=["c_acctbal"], hard_deletes="new_record")
    twice = snapshot.take(once, b.drop("at"), ["c_custkey"], F.lit("2024-03-01").cast("timestamp_ntz"), check=["c_acctbal"], hard_deletes="new_record")
    return twice.select("c_custkey", "c_acctbal", "valid_from", "valid_to", "is_deleted")


# --- data tests -------------------------------------------------------------------------------


@query("q_test_unique", "SELECT l_orderkey AS unique_field, count(*) AS n_records FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def test_unique(spark: SparkSession, sf: str) -> DataFrame:
    return DT.unique(table(spark, sf, "lineitem"), "l_orderkey")


@query("q_test_not_null", "SELECT id, county FROM raw_daft_listings WHERE county IS NULL")
def test_not_null(spark: SparkSession, sf: str) -> DataFrame:
    return DT.not_null(table(spark, sf, "raw_daft_listings").select("id", "county"), "county", whole=True)


@query("q_test_accepted", "SELECT ber_rating AS value_field, count(*) AS n_records FROM raw_daft_listings WHERE ber_rating NOT IN ('A1', 'A2', 'A3', 'B1', 'B2', 'B3') GROUP BY 1")
def test_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return DT.accepted_values(table(spark, sf, "raw_daft_listings"), "ber_rating", ["A1", "A2", "A3", "B1", "B2", "B3"])


@query("q_test_relationships", "SELECT d.property_id AS from_field FROM listing_arrivals d WHERE d.property_id IS NOT NULL AND d.property_id NOT IN (SELECT property_id FROM fact_rental_listings WHERE property_id IS NOT NULL)")
def test_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals write property ids in many ways, so as written many have no parent."""
    return DT.relationships(table(spark, sf, "listing_arrivals"), "property_id", table(spark, sf, "fact_rental_listings"), "property_id")


_CHECKED = ["county", "price", "latitude", "id", "publish_date"]


@query("q_test_aggregated_not_null", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS failures FROM raw_daft_listings WHERE {c} IS NULL HAVING count(*) > 0" for c in _CHECKED))
def test_aggregated_not_null(spark: SparkSession, sf: str) -> DataFrame:
    return DT.aggregated_not_null(table(spark, sf, "raw_daft_listings"), _CHECKED)


@query("q_test_aggregated_unique", " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n_records FROM nation WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1" for c in ("n_nationkey", "n_regionkey", "n_name")))
def test_aggregated_unique(spark: SparkSession, sf: str) -> DataFrame:
    return DT.aggregated_unique(table(spark, sf, "nation"), ["n_nationkey", "n_regionkey", "n_name"])


@query("q_test_evaluation", "SELECT count(*) AS failures, count(*) > 10 AS should_warn, count(*) > 1000000 AS should_error FROM raw_daft_listings WHERE county IS NULL")
def test_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return DT.evaluation(DT.not_null(table(spark, sf, "raw_daft_listings"), "county"), warn_if="> 10", error_if="> 1000000")


@query("q_test_unit", "SELECT n_name, 'actual' AS actual_or_expected FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_name, 'expected' FROM nation WHERE n_regionkey = 1")
def test_unit(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return DT.unit_test(n.where("n_regionkey <> 1").select("n_name"), n.where("n_regionkey <> 0").select("n_name"))


@query("q_test_unique_index", "SELECT source, county_key, coalesce(property_type_key, -1) AS property_type_key, count(*) AS n_records FROM fact_market_summary GROUP BY 1, 2, 3 HAVING count(*) > 1")
def test_unique_index(spark: SparkSession, sf: str) -> DataFrame:
    """Without the month the key is not unique: null property types count as one value."""
    return DT.unique_key(table(spark, sf, "fact_market_summary").withColumn("property_type_key", F.coalesce("property_type_key", F.lit(-1))), ["source", "county_key", "property_type_key"])


@query("q_test_freshness", "SELECT max(scraped_at) AS max_loaded_at, CAST(date_diff('second', max(scraped_at), TIMESTAMP '2025-08-01') AS BIGINT) AS age_seconds FROM raw_daft_listings")
def test_freshness(spark: SparkSession, sf: str) -> DataFrame:
    from datetime import datetime

    return DT.freshness(table(spark, sf, "raw_daft_listings"), "scraped_at", datetime(2025, 8, 1)).select("max_loaded_at", "age_seconds")


# --- models -----------------------------------------------------------------------------------


def market_models(spark: SparkSession, sf: str, store: TableStore) -> Registry:
    """A small layered warehouse over the rental tables: staging views, a fact, a summary and a report."""
    r = Registry(store, {t: (lambda t=t: table(spark, sf, t)) for t in ("raw_daft_listings", "dim_county")})

    @r.model()
    def stg_listings(c):
        return c.source("raw_daft_listings").where("price > 0 AND scraped_at IS NOT NULL").select("id", "property_id", "county", "price", F.col("scraped_at").cast("date").alias("day"), "scraped_at")

    @r.model(materialized="seed")
    def dim_county(c):
        return c.source("dim_county").select("county_key", "county_name")

    @r.model(["stg_listings", "dim_county"], materialized="table", unique_index=[["property_id"]])
    def fact_latest(c):
        latest = R.keep_latest(c.ref("stg_listings"), ["property_id"], ["scraped_at", "id"])
        return R.lookup_name(latest, "county", c.ref("dim_county"), "county_name", "county_key", "county_key")

    @r.model(["fact_latest"], materialized="incremental", unique_key=["county_key"])
    def county_summary(c):
        return c.ref("fact_latest").groupBy("county_key").agg(F.count("*").alias("n"), F.round(F.percentile("price", 0.5), 2).alias("median_price"))

    @r.model(["county_summary", "dim_county"], materialized="materialized_view")
    def report(c):
        return c.ref("county_summary").join(c.ref("dim_county"), "county_key").select("county_name", "n", "median_price")

    return r


@query(
    "q_model_dag",
    """
WITH s AS (SELECT * FROM raw_daft_listings WHERE price > 0 AND scraped_at IS NOT NULL),
f AS (SELECT DISTINCT ON (property_id) property_id, county, price FROM s ORDER BY property_id, scraped_at DESC, id DESC)
SELECT county_name, count(*) AS n, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(price AS DOUBLE)), 2) AS median_price
FROM f JOIN dim_county ON lower(county_name) = lower(county) GROUP BY 1
""",
)
def model_dag(spark: SparkSession, sf: str) -> DataFrame:
    """Build the models twice (the second run is incremental) and read the report."""
    r = market_models(spark, sf, TableStore(spark, new_path(spark, "warehouse")))
    r.run(threads=2)
    r.run(select=["county_summary", "report"])
    return r.store.read("report")


# --- streaming --------------------------------------------------------------------------------


@query("q_stream_append", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events) GROUP BY 1, 2")
def stream_append(spark: SparkSession, sf: str) -> DataFrame:
    """Events through the file stream into a table, one row for each user, type and day."""
    store, check = TableStore(spark, new_path(spark, "stream")), new_path(spark, "stream-checkpoint")
    landed = new_path(spark, "landing")
    table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day")).repartition(4, "event_type").write.parquet(landed)
    s = ingest.landing(spark, landed, "user_id long, event_type string, day date", files_per_batch=2)
    ingest.append_batches(s, store, "seen", ["user_id", "event_type", "day"], check).awaitTermination()
    return store.read("seen").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
