import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthmill.llm import quantiles as Q

PROBS = [0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999]


def exact_share(v, x):
    return float(np.mean(v <= x))


@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=Q.capacity()))
@settings(max_examples=40, deadline=None)
def test_small_groups_are_exact(values):
    s = Q.Sketch()
    s.update(np.array(values))
    got = Sketch_roundtrip(s).quantiles(PROBS)
    v = np.sort(values)
    assert got == [float(v[max(0, int(np.ceil(p * len(v) - 1e-9)) - 1)]) for p in PROBS]


def Sketch_roundtrip(s):
    return Q.Sketch.load(s.dump())


@pytest.mark.parametrize("kind", ["uniform", "lognormal", "sorted", "ties"])
@pytest.mark.parametrize("high", [True, False])
def test_rank_error_is_within_the_bound(kind, high):
    r = np.random.default_rng(5)
    v = {"uniform": r.random(200_000), "lognormal": r.lognormal(7, 2, 200_000), "sorted": np.arange(200_000.0), "ties": r.integers(0, 50, 200_000).astype(float)}[kind]
    s = Q.Sketch(high=high)
    for part in np.array_split(v, 7):
        s.update(part)
    assert s.n == len(v) and sum(map(len, s.levels)) < 12_000
    for p, x in zip(PROBS, s.quantiles(PROBS), strict=True):
        assert exact_share(v, x) >= p - Q.rank_error() and float(np.mean(v < x)) <= p + Q.rank_error()
        assert abs(s.share(x) - exact_share(v, x)) <= Q.rank_error()


def test_protected_tail_has_multiplicative_error():
    r = np.random.default_rng(6)
    v = r.lognormal(7, 2, 300_000)
    for high in (True, False):
        s = Q.Sketch(high=high)
        s.update(v)
        for tail in (1e-4, 1e-3, 1e-2):
            x = s.quantiles([1 - tail if high else tail])[0]
            true = float(np.mean(v > x)) if high else exact_share(v, x)
            assert abs(true - tail) <= 0.12 * tail + 2 / len(v)


def test_merging_in_any_order_keeps_the_bound():
    r = random.Random(3)
    parts = [np.random.default_rng(i).lognormal(i % 5, 1, 3000 + 500 * i) for i in range(20)]
    every = np.concatenate(parts)
    for _ in range(3):
        sketches = []
        for p in parts:
            s = Q.Sketch()
            s.update(p)
            sketches.append(Sketch_roundtrip(s))
        while len(sketches) > 1:
            r.shuffle(sketches)
            sketches[0].merge(sketches.pop())
        assert sketches[0].n == len(every)
        for p, x in zip(PROBS, sketches[0].quantiles(PROBS), strict=True):
            assert abs(exact_share(every, x) - p) <= Q.rank_error()


def test_groups_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, None), ("a", 1, float("nan")), (None, None, 2.0), ("b", 2, 3.0), ("b", 2, 3.0), ("c", 3, None)], "g string, h int, v double")
    got = Q.quantile_columns(Q.sketches(df, ["g", "h"], "v"), {"median": 0.5}).drop("sketch")
    assert sorted(map(str, got.collect())) == sorted(["Row(g='a', h=1, n=1, median=1.0)", "Row(g=None, h=None, n=1, median=2.0)", "Row(g='b', h=2, n=2, median=3.0)"])
    assert Q.sketches(df.limit(0), ["g"], "v").count() == 0
    with pytest.raises(ValueError):
        Q.sketches(df.withColumnRenamed("g", "n"), ["n"], "v")


def test_days_join_into_months(spark):
    df = spark.range(60_000).select((F.col("id") % 30).cast("int").alias("day"), F.lit("x").alias("g"), F.rand(1).alias("v"))
    days = Q.sketches(df, ["g", "day"], "v")
    month = Q.merge_sketches(days, ["g"])
    whole = np.array([r.v for r in df.select("v").collect()])
    r = Q.quantile_columns(month, {"p50": 0.5, "p99": 0.99}).first()
    assert r.n == 60_000 and abs(exact_share(whole, r.p50) - 0.5) <= Q.rank_error() and abs(exact_share(whole, r.p99) - 0.99) <= Q.rank_error()


def test_suspects_agree_with_exact_counts(spark):
    rows = [("g", float(i)) for i in range(5000)] + [("s", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v double")
    stated = spark.createDataFrame([(1, "g", 2500.0), (2, "g", 1000.0), (3, "g", 2005.0), (4, "s", 24.0), (5, "s", 49.0), (6, "s", None), (7, "absent", 1.0)], "k int, g string, m double")
    got, e = Q.percentile_suspects(stated, Q.sketches(df, ["g"], "v"), ["g"], "m")
    by = {r.k: r.sure for r in got.collect()}
    assert by[2] and by[5] and by[3] is False and 1 not in by and 4 not in by and 6 not in by and 0 < e < 0.05


def test_two_tails_are_each_protected():
    r = np.random.default_rng(4)
    v = r.lognormal(7, 1, 200_000)
    both = Q.TwoTails(32)
    for part in np.array_split(v, 50):
        x = Q.TwoTails(32, salt=len(part))
        x.update(part)
        both.merge(Q.load(x.dump()))
    order = np.sort(v)
    for p in (0.0005, 0.01, 0.1, 0.5, 0.9, 0.99, 0.9995):
        (q,) = both.quantiles([p])
        rank = np.searchsorted(order, q, side="right") / len(v)
        assert abs(rank - p) <= Q.rank_error(32, 3.0, min(p, 1 - p)), p
    assert Q.load(both.dump()).n == len(v) and Q.rank_error(tail=0.01) < Q.rank_error(tail=0.1) < Q.rank_error()


def test_salted_coins_differ_on_equal_days():
    day = np.arange(5000.0)
    a, b = Q.Sketch(16, salt=1), Q.Sketch(16, salt=2)
    a.update(day)
    b.update(day)
    assert a.dump() != b.dump()


def test_a_hot_group_is_merged_in_two_levels(spark):
    df = spark.range(0, 40_000, 1, 16).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), F.col("id").cast("double").alias("v"))
    s = Q.sketches(df, ["g"], "v", high=None)
    got = {x.g: x for x in Q.error_columns(Q.quantile_columns(s, {"p50": 0.5}), {"p50": 0.5}).collect()}
    assert got["hot"].n == 13_334 and abs(got["hot"].p50 / 40_000 - 0.5) <= got["hot"].p50_error and sum(x.n for x in got.values()) == 40_000
