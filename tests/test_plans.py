import json
import math
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hearthmill.plans import data_tests, loaders, runner, snapshot, strategies
from hearthmill.plans.registry import Registry, model_name, row_counts
from hearthmill.queries.maintenance import market_models
from hearthmill.session import ship
from tests.conftest import rows


@pytest.fixture
def tb(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "c"), (3, "c")], "k int, v string")
    return t, b


def test_delete_insert_keeps_batch_repeats_and_null_keys(tb):
    assert rows(strategies.delete_insert(*tb, ["k"])) == [(1, "a"), (2, "B"), (3, "c"), (3, "c"), (None, "n")]
    assert rows(strategies.delete_insert(*tb, ["k"], F.col("v") == "x")) == [(1, "a"), (2, "B"), (2, "b"), (3, "c"), (3, "c"), (None, "n")]


def test_merge(tb):
    t, b = tb
    with pytest.raises(strategies.DuplicateKeys):
        strategies.merge(t, b, ["k"])
    assert rows(strategies.merge(t, b.distinct(), ["k"])) == [(1, "a"), (2, "B"), (3, "c"), (None, "n")]
    assert rows(strategies.merge(t, b.distinct(), ["k"], exclude=["v"])) == [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
    assert strategies.merge(t, b, None).count() == 6
    assert rows(strategies.upsert(t, b.distinct(), ["k"], ["v"])) == [(1, "a"), (2, "B"), (3, "c"), (None, "n")]


def test_high_water_and_insert_ignore(spark, tb):
    t, b = tb
    assert rows(strategies.newer_than(b, "k", t)) == [(3, "c"), (3, "c")]
    assert strategies.newer_than(b, "k", t.limit(0)).count() == 0
    assert strategies.newer_than(b, "k", None).count() == 3
    assert rows(strategies.insert_ignore(t, b.unionByName(spark.createDataFrame([(None, "again")], "k int, v string")), ["k"])) == [(3, "c")]


def test_schema_sync_modes(spark, tb):
    t = tb[0]
    b = spark.createDataFrame([(4, 1.5)], "k long, extra double")
    with pytest.raises(strategies.SchemaChange):
        strategies.sync_schema(t, b, "fail")
    assert [strategies.sync_schema(t, b, m)[0].columns for m in ("ignore", "append_new_columns", "sync_all_columns")] == [["k", "v"], ["k", "v", "extra"], ["k", "extra"]]
    a, c = strategies.sync_schema(t, b, "sync_all_columns")
    assert a.schema == c.schema and dict(a.dtypes)["k"] == "bigint"


def test_microbatch_needs_key(tb):
    with pytest.raises(ValueError):
        strategies.microbatch(*tb, "k", [], [])


# --- snapshots


def snap(df, *cols):
    return rows(df.select(*cols, F.date_format("valid_from", "MM-dd"), F.date_format("valid_to", "MM-dd"), "is_deleted"))


def test_snapshot_check_null_to_value_and_return_of_deleted(spark):
    at = lambda d: F.lit(datetime(2024, 1, d)).cast("timestamp_ntz")
    v = lambda *r: spark.createDataFrame(list(r), "k int, a int")
    s = snapshot.first(v((1, None), (2, 7)), ["k"], at(1))
    s = snapshot.take(s, v((1, 5)), ["k"], at(2), check="all", hard_deletes="new_record")
    assert snap(s, "k", "a") == [(1, 5, "01-02", None, False), (1, None, "01-01", "01-02", False), (2, 7, "01-01", "01-02", False), (2, 7, "01-02", None, True)]
    assert s.select("scd_id").distinct().count() == s.count()
    s = snapshot.take(s, v((1, 5)), ["k"], at(3), check=["a"], hard_deletes="new_record")
    assert s.count() == 4  # the deletion record is not deleted again
    s = snapshot.take(s, v((1, 5), (2, 7)), ["k"], at(4), check=["a"], hard_deletes="new_record")
    assert (2, 7, "01-04", None, False) in snap(s, "k", "a")


def test_snapshot_time_strategy_and_modes(spark):
    v = lambda *r: spark.createDataFrame(list(r), "k int, a int, u timestamp_ntz")
    d = lambda x: datetime(2024, 1, x)
    s = snapshot.first(v((1, 1, d(1)), (2, 1, d(1))), ["k"], F.col("u"))
    now = F.lit(d(9)).cast("timestamp_ntz")
    kept = snapshot.take(s, v((1, 2, d(1)), (3, 3, d(5))), ["k"], now, updated_at="u")
    assert snap(kept, "k", "a") == [(1, 1, "01-01", None, False), (2, 1, "01-01", None, False), (3, 3, "01-05", None, False)]
    shut = snapshot.take(s, v((1, 2, d(3))), ["k"], now, updated_at="u", hard_deletes="invalidate")
    assert snap(shut, "k", "a") == [(1, 1, "01-01", "01-03", False), (1, 2, "01-03", None, False), (2, 1, "01-01", "01-09", False)]
    with pytest.raises(ValueError):
        snapshot.take(s, s, ["k"], now)


def test_snapshot_added_column_changes_every_row(spark):
    s = snapshot.first(spark.createDataFrame([(1, 1)], "k int, a int"), ["k"], F.lit(date(2024, 1, 1)))
    wide = spark.createDataFrame([(1, 1, "x")], "k int, a int, b string")
    assert snapshot.take(s, wide, ["k"], F.lit(date(2024, 1, 2)), check=["a", "b"]).count() == 2


# --- store, registry, tests


def test_store_lifecycle(spark, store, tb):
    t, b = tb
    assert not store.exists("t") and store.names() == []
    store.write("t", t)
    store.append("t", b.select("k"))
    assert store.read("t").count() == 6
    with pytest.raises(ValueError):
        store.append("t", b.withColumn("odd", F.lit(1)))
    store.write("t", store.read("t").where("k = 1"))
    assert rows(store.read("t")) == [(1, "a")] and store.vacuum("t") == 1
    store.clone("t", "c")
    store.rename("t", "u")
    assert store.names() == ["c", "u"]
    store.truncate("u")
    assert store.counts() == {"c": 0, "u": 0} if store.exists("t") else store.read("u").count() == 0
    store.drop("u")
    store.drop("nothing")
    with pytest.raises(KeyError):
        store.read("u")


def test_models_build_in_order(spark, store, data):
    r = market_models(spark, data, store)
    assert r.order().index("stg_listings") < r.order().index("fact_latest") < r.order().index("report")
    assert r.dependents("dim_county") == [n for n in r.order() if n in ("fact_latest", "county_summary", "report")]
    assert set(r.run(threads=3).values()) == {"ok"}
    first = rows(store.read("report"))
    assert set(r.run(["report"]).values()) == {"ok"} and rows(store.read("report")) == first
    assert row_counts(store).count() == 5


def test_models_in_threads_ship_once():
    """Spark takes a file name from one path only; the first models of a run read their sources at the same time."""
    sent = []

    def add(path):
        time.sleep(0.05)
        sent.append(path)
        if len(set(sent)) > 1:
            raise ValueError("already registered with a different path")

    for app in ("app-1", "app-2"):
        sent.clear()
        spark = SimpleNamespace(sparkContext=SimpleNamespace(applicationId=app, addPyFile=add))
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda _, s=spark: ship(s), range(4)))
        assert len(sent) == 1


def test_registry_errors(spark, store):
    r = Registry(store, {})

    @r.model(materialized="table")
    def bad(c):
        raise RuntimeError("no")

    @r.model(["bad"], materialized="table")
    def below(c):
        return c.ref("bad")

    assert r.run(keep_going=True) == {"bad": "RuntimeError: no", "below": "skipped"}

    @r.model(materialized="table", unique_index=[["id"]])
    def twice(c):
        return c.spark.createDataFrame([(1,), (1,)], "id int")

    with pytest.raises(strategies.DuplicateKeys):
        r.build("twice")

    @r.model(materialized="table")
    def undeclared(c):
        return c.ref("twice")

    with pytest.raises(ValueError):
        r.build("undeclared")


def test_materialized_view_configuration(spark, store):
    r = Registry(store, {})

    @r.model(materialized="materialized_view", on_configuration_change="fail", size=1)
    def v(c):
        return c.spark.range(c.config["size"])

    r.build("v")
    r.models["v"].options["size"] = 2
    with pytest.raises(strategies.SchemaChange):
        r.build("v")
    r.models["v"].options["on_configuration_change"] = "continue"
    assert r.build("v").count() == 1
    assert r.build("v", full_refresh=True).count() == 2


def test_data_tests(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "b")], "k int, v string")
    assert rows(data_tests.unique(df, "k")) == [(1, 2)]
    assert data_tests.not_null(df, "v").count() == 1
    assert rows(data_tests.accepted_values(df, "v", ["a"])) == [("b", 1)]
    assert rows(data_tests.relationships(df, "k", df.limit(0), "k")) == [(1,), (1,)]
    assert data_tests.run(data_tests.unique(df, "k"), warn_if="> 0", error_if="> 5").status == "warn"
    assert data_tests.run(df.limit(0)).status == "pass"
    assert data_tests.contract(df, "k int, v int, w int") == [("v", "int", "string"), ("w", "int", "missing")]
    assert data_tests.prerequisites({"a": 0, "b": 3}, ["a", "b", "c"]) == ["a", "c"]
    assert "Scan" in data_tests.explains(df)
    assert data_tests.unique_key(spark.createDataFrame([(None,), (None,)], "k int"), ["k"], -1).count() == 1
    assert data_tests.freshness(df.limit(0).withColumn("t", F.current_timestamp()), "t").first().max_loaded_at is None
    assert rows(data_tests.all_failures({"u": data_tests.unique(df, "k")})) == [("u", 1)]


# --- loaders, runner


def test_cube_loader_incremental(spark, store):
    feed = loaders.cubes()["income"]
    raw = lambda *r: spark.createDataFrame(list(r), "`﻿STATISTIC` string, `TLIST(A1)` string, C02196V02652 string, C02196V02652_Label string, Other_Label string, VALUE string")
    assert loaders.load_cube(store, raw(("S", "2020", "1", "Dublin", "x", "10.5"), ("S", "2020", "1", "Dublin", "x", "10.5"), ("S", "2021", "1", "Dublin", "x", "bad")), feed)
    assert loaders.load_mode(store, feed.table, "year") == ("incremental", 2021)
    assert loaders.load_cube(store, raw(("S", "2021", "2", "Cork", "x", "3"), ("S", "2022", "2", "Cork", "x", "3")), feed)
    got = rows(store.read(feed.table).select("year", "location_label", "value"))
    # rows of one batch are never held against each other
    assert [(y, n, None if v is None else float(v)) for y, n, v in got] == [(2020, "Dublin", 10.5), (2020, "Dublin", 10.5), (2021, "Dublin", None), (2022, "Cork", 3.0)]
    assert loaders.load_mode(store, feed.table, "year", force_full=True) == ("full", None)
    assert not loaders.load_cube(store, raw(), loaders.Feed(feed.table, "bad schema(", feed.keys))


@pytest.mark.parametrize("name", ["rent", "cpi", "population", "income"])
def test_cube_counts_every_cell(name, spark, store):
    feed = loaders.cubes()[name]
    period = [d for d in feed.dims if d.startswith("TLIST")][-1]
    dims = ["STATISTIC", period, *[d for d in feed.dims if not d.startswith(("STAT", "TLIST"))]]
    codes = [["S1"], ["2023", "2024"] if period == "TLIST(A1)" else ["2023Q4", "2024Q1", "2024Q2"], *[["a", "b", "c"]] * (len(dims) - 2)]
    cells = math.prod(map(len, codes))
    body = {"id": dims, "size": list(map(len, codes)), "value": list(range(cells)), "dimension": {d: {"category": {"index": c, "label": {x: f"L {x}" for x in c}}} for d, c in zip(dims, codes, strict=True)}}
    text = spark.createDataFrame([(json.dumps(body),)], "body string")
    assert loaders.load_cube_text(store, text, "body", feed)
    got = store.read(feed.table)
    assert got.count() == cells and {r[0] for r in got.select("year").collect()} == {2023, 2024}
    assert got.where(" OR ".join(f"{k} IS NULL" for k in feed.keys)).count() == 0 and got.where("source = 'cso.ie' AND date_fetched IS NOT NULL").count() == cells
    assert loaders.load_cube_text(store, text, "body", feed) and store.read(feed.table).count() == cells


def test_cube_with_unknown_headers_fails(spark, store):
    raw = spark.createDataFrame([("S", "2020", "Dublin", "1")], "STATISTIC string, Year string, `Some Place` string, VALUE string")
    assert not loaders.load_cube(store, raw, loaders.cubes()["income"])
    published = raw.withColumnRenamed("Some Place", "County and Region")
    assert loaders.load_cube(store, published, loaders.cubes()["income"]) and store.read("raw_cso_income").first().location_label == "Dublin"


def test_load_keeps_the_first_row_read(spark, store):
    feed = loaders.Feed("first", "k int, v int", ["k"])
    df = spark.createDataFrame([(i % 5, i) for i in range(100)], "k int, v int").coalesce(1)
    assert loaders.load(store, df, feed) == 5 and rows(store.read("first")) == [(i, i) for i in range(5)]


def test_load_rows_and_dispatch(spark, store):
    feed = loaders.Feed("t", "id int, flag boolean, tags string", ["id"], first_by=["tags"])
    assert loaders.load_rows(store, [{"id": "1", "flag": "true"}, {"id": "x"}, {"id": "1", "tags": "a"}], feed, "id string, flag string, tags string") == 2
    assert rows(store.read("t")) == [(1, None, "a"), (None, None, None)]
    assert loaders.load_all(store, {"a": spark.createDataFrame([(5,)], "id int"), "b": None, "c": spark.range(1)}, {"a": feed}) == {"a": 1, "c": -1}


def test_runner():
    seen = []
    steps = {"a": lambda s: seen.append("a"), "b": lambda s: 1 / 0, "c": lambda s: s.source}
    out = runner.run(steps, runner.parse_args(["--source", "cubes", "--force-full"]))
    assert out.exit_code == 1 and list(out.errors) == ["b"] and out.results["c"] == "cubes"
    assert runner.run(steps, runner.Settings(), only=["a"]).exit_code == 0
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert runner.with_retries(flaky, 2, 10, waits.append) == "ok" and waits == [10, 20]


def test_sql_scripts(spark):
    steps = runner.sql_scripts(spark, {"x": "CREATE OR REPLACE TEMP VIEW script_v AS SELECT 1 AS a;\nSELECT * FROM script_v;\n"})
    assert runner.run(steps, runner.Settings()).results == {"x": 2}
