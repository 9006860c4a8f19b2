import pytest
from pyspark.sql import functions as F

from hearthmill.operators import relational as R
from hearthmill.operators import rules
from tests.conftest import rows


@pytest.fixture
def df(spark):
    return spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 2, 20.0), (None, 1, 5.0), (None, 3, None), ("b", None, 1.0)], "k string, t int, v double")


def test_keep_latest_and_first(df):
    assert rows(R.keep_latest(df, ["k"], ["t"])) == [("a", 2, 20.0), ("b", None, 1.0), (None, 3, None)]
    assert rows(R.keep_first(df, ["k"], [F.col("t").asc_nulls_last(), F.col("v")])) == [("a", 1, 10.0), ("b", None, 1.0), (None, 1, 5.0)]
    assert R.keep_latest(df.limit(0), ["k"], ["t"]).count() == 0


def test_period_change_counts_rows_not_calendar(spark):
    s = spark.createDataFrame([("x", 1, 100.0), ("x", 3, 110.0), ("x", 4, 0.0), ("x", 5, 7.0)], "k string, m int, v double")
    got = R.period_change(s, ["k"], "m", "v", {"mom": 1}).orderBy("m").collect()
    assert [r.mom_before for r in got] == [None, 100.0, 110.0, 0.0]
    assert got[1].mom_pct == pytest.approx(10) and got[3].mom_pct is None


def test_trend_edges(spark):
    s = spark.createDataFrame([(5.0,), (5.1,), (1.0,), (1.1,), (-1.0,), (-1.1,), (-5.0,), (-5.1,), (None,)], "p double")
    got = [r.t for r in s.select(rules.trend(F.col("p"), [(5, "Strong"), (1, "")], "Stable").alias("t")).collect()]
    assert got == ["Up", "Strong Up", "Stable", "Up", "Stable", "Down", "Down", "Strong Down", "Stable"]


def test_bands_and_rules(spark):
    s = spark.createDataFrame([(999.99,), (1000.0,), (2500.0,), (None,)], "p double")
    assert [r.b for r in s.select(rules.bands(F.col("p"), [(1000, "Low"), (2500, "Mid")], "Top", null="none").alias("b")).collect()] == ["Low", "Mid", "Top", "none"]
    t = spark.createDataFrame([("Studio Apartment",), ("x",), (None,)], "t string")
    assert [r.c for r in t.select(rules.like_rules(F.col("t"), [("%apartment%", "Apartment"), ("%studio%", "Studio")], "Other").alias("c")).collect()] == ["Apartment", "Other", "Other"]
    assert [r.c for r in t.select(rules.regex_rules(F.col("t"), [("^S", 1)], 0).alias("c")).collect()] == [1, 0, 0]
    assert [r.f for r in t.select(rules.flag(F.col("t") == "x").alias("f")).collect()] == [0, 1, 0]


def test_joins(spark, df):
    other = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(R.anti_null_safe(df, other, ["k"])) == [("b", None, 1.0)]
    assert R.semi(df, other, ["k"]).count() == 3
    dim = spark.createDataFrame([("A", 7), ("A", 9), ("B", 8)], "name string, key int")
    assert rows(R.lookup_name(df.select("k").distinct(), "k", dim, "name", "key", "key")) == [("a", 7), ("b", 8), (None, None)]
    with pytest.raises(ValueError):
        R.with_constant_row(df, dim)
    assert [r.z for r in R.with_constant_row(df.limit(1), dim.limit(0).select(F.col("key").alias("z"))).collect()] == [None]


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 1), (None, 2), ("alone", 3)], "k string, v int")
    other = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("cold", "z")], "k string, w string")
    for how in ("inner", "left"):
        assert rows(R.salted_join(big, other, ["k"], how, salts=4).select("k", "v", "w")) == rows(big.join(other, "k", how).select("k", "v", "w"))
    with pytest.raises(ValueError):
        R.salted_join(big, other, ["k"], "full")


def test_numbered_is_consecutive(spark):
    s = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("v"))
    got = R.numbered(s, [F.col("v")], bucket_rows=100).orderBy("v").collect()
    assert [r.key for r in got] == list(range(1, 1001))
    assert R.numbered(s.limit(0), [F.col("v")]).count() == 0


def test_sets_and_lists(spark, df):
    assert rows(R.union_distinct([df.select("k"), df.select("k")])) == [("a",), ("b",), (None,)]
    assert rows(R.distinct_list(df, ["k"], "t", "ts")) == [("a", "1,2"), (None, "1,3")]
    assert R.at_latest(df, "t").count() == 1
    assert R.top_n(df, ["k"], [F.col("t").desc_nulls_last()], 1).count() == 3
    merged = R.full_merge([df.groupBy("k").count().na.drop(), df.where("k = 'a'").groupBy("k").agg(F.max("v").alias("m"))], ["k"])
    assert rows(merged) == [("a", 3, 20.0), ("b", 1, None)]
