import math
import random

from hearthmill.operators import geo
from tests.conftest import rows


def haversine(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def brute(points, radius):
    return sorted((a[0], b[0]) for i, a in enumerate(points) for b in points[i + 1 :] if haversine(a[1:], b[1:]) <= radius for a, b in [sorted((a, b))])


def points(n, seed=1):
    r = random.Random(seed)
    base = [(53.3 + r.random() * 0.01, -6.3 + r.random() * 0.01) for _ in range(n // 4)]
    return [(i, *[x + r.choice([0, 0, 0.0001, 0.0003]) for x in r.choice(base)]) for i in range(n)]


def test_near_pairs_against_brute_force(spark):
    p = points(400)
    df = spark.createDataFrame(p, "k long, lat double, lon double")
    got = geo.near_pairs(df, "k", "lat", "lon", 30.0).select("first_key", "second_key")
    assert rows(got) == sorted(brute(p, 30.0), key=lambda r: tuple((False, str(x)) for x in r))


def test_crowded_place_is_spread_over_blocks(spark):
    p = [(i, 53.0, -6.0) for i in range(60)] + [(100 + i, 53.0001, -6.0) for i in range(30)]
    df = spark.createDataFrame(p, "k long, lat double, lon double")
    got = geo.near_pairs(df, "k", "lat", "lon", 30.0, block=7)
    assert got.select("first_key", "second_key").distinct().count() == got.count() == 90 * 89 // 2


def test_near_pairs_edges(spark):
    df = spark.createDataFrame(
        [(1, 53.0, -6.0, "a"), (2, 53.0, -6.0, None), (3, None, -6.0, "c"), (4, 53.0, None, "d"), (5, 999.0, 0.0, "e"), (None, 53.0, -6.0, "f"), (6, 89.99, 10.0, "g"), (7, 89.99, 10.1, "h")],
        "k long, lat double, lon double, first_key string",
    )
    assert rows(geo.near_pairs(df, "k", "lat", "lon", 30.0).select("first_key", "second_key")) == [(1, 2), (6, 7)]
    assert geo.near_pairs(df.limit(0), "k", "lat", "lon", 30.0).count() == 0


def test_near_points_keeps_clashing_columns_apart(spark):
    a = spark.createDataFrame([(1, 53.0, -6.0)], "id int, lat double, lon double")
    b = spark.createDataFrame([(7, 53.0001, -6.0), (8, 53.1, -6.0)], "id int, lat double, lon double")
    assert [(r.left.id, r.right.id) for r in geo.near_points(a, b, 30.0).collect()] == [(1, 7)]


def test_points_in_boxes(spark):
    boxes = [("A", 53.0, 53.5, -7.0, -6.0), ("B", 53.4, 54.0, -7.0, -6.0)]
    df = spark.createDataFrame([(1, 53.45, -6.5), (2, 53.9, -6.0), (3, 10.0, 10.0), (4, None, None), (5, 53.5, -7.0)], "k int, lat double, lon double")
    assert rows(geo.points_in_boxes(df, "lat", "lon", boxes, default="none").select("k", "region")) == [(1, "A"), (2, "B"), (3, "none"), (4, "none"), (5, "A")]
    assert geo.points_in_boxes(df, "lat", "lon", boxes, max_cells=4).where("region = 'A'").count() == 2
    assert geo.points_in_boxes(df, "lat", "lon", []).where("region IS NOT NULL").count() == 0


def test_morton_orders_cells(spark):
    r = spark.range(1).select(geo.morton(geo.F.lit(3), geo.F.lit(5)).alias("m")).first()
    assert r.m == 0b100111
