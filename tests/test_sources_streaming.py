import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hearthmill.session import new_path
from hearthmill.sources import files, generators
from hearthmill.streaming import ingest
from tests.conftest import rows


def test_literal_rows(spark):
    assert rows(generators.literal_rows(spark, [{"a": 1}, {"b": "x"}], "a int, b string")) == [(1, None), (None, "x")]
    assert generators.literal_rows(spark, [], "a int").count() == 0
    with pytest.raises(ValueError):
        generators.literal_rows(spark, [{"z": 1}], "a int")


def test_spines(spark):
    assert generators.date_spine(spark, date(2024, 1, 1), date(2024, 1, 3)).count() == 3
    assert generators.date_spine(spark, date(2024, 1, 1), date(2024, 1, 3), inclusive=False).count() == 2
    assert generators.date_spine(spark, date(2024, 1, 1), date(2024, 12, 31), "quarter").count() == 4
    assert generators.date_spine(spark, date(2024, 2, 1), date(2024, 1, 1)).count() == 0
    assert generators.integer_series(spark, 0).count() == 0
    with pytest.raises(ValueError):
        generators.date_spine(spark, date(2024, 1, 1), date(2024, 1, 3), "fortnight")


def test_cube_edges(spark):
    cube = {"id": ["A", "B"], "size": [2, 3], "value": [0, 1, 2, 3, 4], "dimension": {"A": {"category": {"index": ["x", "y"], "label": {}}}, "B": {"category": {"index": {"r": 2, "p": 0, "q": 1}, "label": {"p": "P"}}}}}
    df = spark.createDataFrame([(1, json.dumps(cube)), (2, "no cube"), (3, None)], "k int, body string")
    got = files.flatten_cube(df, "body", ["A", "B"], keep=["k"]).orderBy("position").collect()
    assert [(r.k, r.A, r.B, r.B_Label, r.value) for r in got] == [(1, "x", "p", "P", 0), (1, "x", "q", "q", 1), (1, "x", "r", "r", 2), (1, "y", "p", "P", 3), (1, "y", "q", "q", 4)]


def test_pages(spark):
    html = '<title> A </title><div class="card"><b>Flat</b> in Cork</div><div class="card">House</div>'
    df = spark.createDataFrame([(html,), ("",), (None,)], "h string")
    assert [r.t for r in df.select(files.page_title(F.col("h")).alias("t")).collect()] == ["A", None, None]
    pick = files.cards(F.col("h"), [r"(?s)<li>(.*?)</li>", r'(?s)<div class="card">(.*?)</div>'], longest=6)
    assert [r.c for r in df.select(pick.alias("c")).collect()][:2] == [["Flat i", "House"], []]
    assert df.select(files.embedded_json(F.col("h"), "x").alias("j")).where("j IS NOT NULL").count() == 0


def test_files_and_catalog(spark, tmp_path):
    p = tmp_path / "seed.csv"
    p.write_text("a,b\n1,x\n2,y\n")
    assert files.seed_csv(spark, str(p), {"a": "long"}).dtypes == [("a", "bigint"), ("b", "string")]
    assert files.seed_csv(spark, str(p)).dtypes == [("a", "int"), ("b", "string")]
    df = files.scan(spark, str(p), "csv", "a int, b string", header="true")
    df.createOrReplaceTempView("seed_view")
    assert files.exists(spark, "seed_view") and "seed_view" in files.relations(spark, "seed_*") and not files.relations(spark, "seed_*", exclude="*view")
    assert files.columns(spark, "seed_view") == [("a", "int"), ("b", "string")] == files.query_columns(spark, "SELECT * FROM seed_view WHERE false")
    assert files.rows_of(spark, "SELECT b FROM seed_view WHERE a = :a", a=2) == [{"b": "y"}]
    assert files.catalog(spark).where("relation = 'seed_view'").count() == 2


def test_stream_append_is_idempotent_over_batches(spark, store):
    folder, check = new_path(spark, "landing"), new_path(spark, "check")
    spark.createDataFrame([(1, "a"), (1, "a"), (None, "n")], "k int, v string").coalesce(1).write.parquet(folder)
    stream = ingest.landing(spark, folder, "k int, v string", files_per_batch=1)
    ingest.append_batches(stream, store, "t", ["k"], check).awaitTermination()
    spark.createDataFrame([(1, "late"), (2, "b"), (None, "again")], "k int, v string").coalesce(1).write.mode("append").parquet(folder)
    ingest.append_batches(stream, store, "t", ["k"], check).awaitTermination()
    assert rows(store.read("t")) == [(1, "a"), (2, "b"), (None, "n")]


def test_stream_windows_and_dedup(spark):
    folder = new_path(spark, "landing")
    data = [(1, datetime(2024, 1, 1, 0, 5), 1.0), (1, datetime(2024, 1, 1, 0, 6), 2.0), (2, datetime(2024, 1, 1, 1, 5), 3.0), (9, datetime(2024, 1, 2), 0.0)]
    spark.createDataFrame(data, "k int, ts timestamp, v double").write.parquet(folder)
    s = ingest.landing(spark, folder, "k int, ts timestamp, v double")
    q = ingest.windowed_counts(ingest.newest_first(s, "k", 0), "ts", ["k"], "v").writeStream.format("memory").queryName("wc").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.sql("SELECT k, n, total FROM wc")) == [(1, 2, 3.0), (2, 1, 3.0)]
    q = ingest.distinct_within(s, ["k"], "ts", "2 hours").writeStream.format("memory").queryName("dw").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT k FROM dw").count() == 3
