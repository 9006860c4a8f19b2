"""Points near other points or inside regions, by space-filling-curve cells.

A point's cell is the Morton code (bit-interleaved column and row) of a grid of
equal latitude and longitude steps. A disc or region is covered by ranges of
codes. Ranges made of whole quadtree cells are prefix ranges, so the range join
of points on covers runs as a sort-merge join on the cut codes: no cross
join, and Spark may split hot cells. Candidates are then refined exactly.

Points at the very same place are joined once as one place and expanded into
pairs afterwards; the members of a crowded place are spread over salted blocks,
so that no task holds all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: bits for each axis of a leaf cell; 26 bits are about 0.6 m of latitude
LEAF_BITS = 26


def _spread(x: Column) -> Column:
    """The low 26 bits of ``x``, one zero bit between each two (magic-mask interleave)."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(col: Column, row: Column) -> Column:
    """Morton code of a grid cell: column bits at even places, row bits at odd ones."""
    return _spread(col.cast("long")).bitwiseOR(F.shiftleft(_spread(row.cast("long")), 1))


def grid_col(lon: Column, bits: int = LEAF_BITS) -> Column:
    return F.least(F.floor((lon + 180.0) / 360.0 * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")


def grid_row(lat: Column, bits: int = LEAF_BITS) -> Column:
    return F.least(F.floor((lat + 90.0) / 180.0 * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")


def cell(lat: Column, lon: Column, bits: int = LEAF_BITS) -> Column:
    """Code of the cell of ``2**bits`` rows and columns that holds a point."""
    return morton(grid_col(lon, bits), grid_row(lat, bits))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres (haversine)."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bits_for(radius_m: float, max_abs_lat: float) -> int:
    """The finest grid whose cells are at least as wide and high as a disc, so that a disc touches four cells at most."""
    lat_step = math.degrees(2 * radius_m / EARTH_RADIUS_M)
    lon_step = lat_step / max(1e-6, math.cos(math.radians(min(89.0, max_abs_lat))))
    return max(1, min(LEAF_BITS, math.floor(min(math.log2(180 / lat_step), math.log2(360 / lon_step)))))


def disc_cells(lat: Column, lon: Column, radius_m: float, bits: int) -> Column:
    """Array of the cells that cover a disc: those that its bounding box touches."""
    reach = math.degrees(radius_m / EARTH_RADIUS_M) * 1.000001
    dlon = F.lit(reach) / F.cos(F.radians(F.least(F.abs(lat) + reach, F.lit(89.9))))
    cols = F.sequence(grid_col(F.greatest(lon - dlon, F.lit(-180.0)), bits), grid_col(F.least(lon + dlon, F.lit(180.0)), bits))
    rows = F.sequence(grid_row(F.greatest(lat - reach, F.lit(-90.0)), bits), grid_row(F.least(lat + reach, F.lit(90.0)), bits))
    return F.flatten(F.transform(cols, lambda x: F.transform(rows, lambda y: morton(x, y))))


def near_pairs(
    df: DataFrame,
    key: str,
    lat: str,
    lon: str,
    radius_m: float,
    max_abs_lat: float = 60.0,
    first: str = "first_key",
    second: str = "second_key",
    block: int = 4096,
) -> DataFrame:
    """All pairs of rows at most ``radius_m`` apart: (first, second, distance_m), smaller key first.

    Rows with a null or non-finite coordinate, or a null key, take no part. A row never
    pairs with one of the same key; repeated rows give repeated pairs.
    Latitudes beyond ``max_abs_lat`` are still right, their discs only touch more cells.
    Discs across the 180th meridian and over a pole are not joined to the other side.
    ``block``: rows of one place handled together when a crowded place is expanded.
    """
    pts = df.select(F.col(key).alias("k"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where(
        F.col("k").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    )
    # one row for each place, with the number of blocks that its members are spread over
    places = pts.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    places = places.withColumn("blocks", F.ceil(F.col("n") / F.lit(float(block))).cast("int"))
    bits = bits_for(radius_m, max_abs_lat)
    data = places.select("lat", "lon", F.col("blocks"), cell(F.col("lat"), F.col("lon"), bits).alias("cell"))
    probe = places.select(
        F.col("lat").alias("lat_a"),
        F.col("lon").alias("lon_a"),
        F.col("blocks").alias("blocks_a"),
        F.explode(disc_cells(F.col("lat"), F.col("lon"), radius_m, bits)).alias("cell"),
    )
    near = (
        probe.join(data, "cell")
        .where((F.col("lat_a") < F.col("lat")) | ((F.col("lat_a") == F.col("lat")) & (F.col("lon_a") <= F.col("lon"))))
        .withColumn("distance_m", distance_m(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon")))
        .where(F.col("distance_m") <= radius_m)
        .select("lat_a", "lon_a", "blocks_a", "lat", "lon", "blocks", "distance_m")
    )
    same = (F.col("lat_a") == F.col("lat")) & (F.col("lon_a") == F.col("lon"))
    # expand places to rows: every pair of places becomes blocks_a x blocks pairs of blocks
    blocks = near.withColumn("ba", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1))).withColumn(
        "bb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    blocks = blocks.where(~same | (F.col("ba") <= F.col("bb"))).withColumn("same", same & (F.col("ba") == F.col("bb")))
    crowded = places.where("blocks > 1").select("lat", "lon", "blocks")
    member = (
        pts.join(crowded, ["lat", "lon"], "left")
        .withColumn("b", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")))
        .select("k", "lat", "lon", "b")
    )
    a = member.select(F.col("k").alias("ka"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("b").alias("ba"))
    b = member.select(F.col("k").alias("kb"), "lat", "lon", F.col("b").alias("bb"))
    pairs = blocks.join(a, ["lat_a", "lon_a", "ba"]).join(b, ["lat", "lon", "bb"]).where(F.when(F.col("same"), F.col("ka") < F.col("kb")).otherwise(F.col("ka") != F.col("kb")))
    return pairs.select(F.least("ka", "kb").alias(first), F.greatest("ka", "kb").alias(second), "distance_m")


# --- regions ----------------------------------------------------------------------------------


def box_cells(boxes: list[tuple[float, float, float, float]], max_cells: int = 65536, bits: int = 20) -> tuple[int, dict[int, list[int]]]:
    """Cover of boxes by cells of one level: (bits, cell code -> numbers of the boxes that touch it).

    The level is the finest (up to ``bits``) at which all covers together have at most ``max_cells`` cells.
    """

    def span(box: tuple[float, float, float, float], n: int) -> tuple[range, range]:
        size = 1 << n

        def at(x: float, low: float, width: float) -> int:
            return max(0, min(size - 1, math.floor((x - low) / width * size)))

        a, b, c, d = box
        return range(at(min(c, d), -180, 360), at(max(c, d), -180, 360) + 1), range(at(min(a, b), -90, 180), at(max(a, b), -90, 180) + 1)

    while bits > 1 and sum(len(x) * len(y) for x, y in (span(q, bits) for q in boxes)) > max_cells:
        bits -= 1
    cover: dict[int, list[int]] = {}
    for i, q in enumerate(boxes):
        cols, rows = span(q, bits)
        for c in cols:
            for r in rows:
                code = sum(((c >> k & 1) << 2 * k) | ((r >> k & 1) << 2 * k + 1) for k in range(bits))
                cover.setdefault(code, []).append(i)
    return bits, cover


def points_in_boxes(
    df: DataFrame, lat: str, lon: str, boxes: list[tuple[str, float, float, float, float]], out: str = "region", default: str | None = None, max_cells: int = 65536
) -> DataFrame:
    """``df`` with the name of the first box (name, lat0, lat1, lon0, lon1; inclusive, in list order) that holds each point.

    The cover table has at most ``max_cells`` rows whatever the data, so it is
    broadcast; a point meets only the boxes of its own cell and these are tested
    exactly. Points outside all boxes, and those with a null coordinate, get
    ``default``; no row is lost or repeated.
    """
    if not boxes:
        return df.withColumn(out, F.lit(default).cast("string"))
    bits, cover = box_cells([b[1:] for b in boxes], max_cells)
    cells = df.sparkSession.createDataFrame(sorted(cover.items()), "__cell bigint, __cand array<int>")
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    hit = F.lit(None).cast("string")
    for i in reversed(range(len(boxes))):
        name, a, b, c, d = boxes[i]
        inside = F.array_contains("__cand", i) & la.between(min(a, b), max(a, b)) & lo.between(min(c, d), max(c, d))
        hit = F.when(inside, F.lit(name)).otherwise(hit)
    ok = la.between(-90, 90) & lo.between(-180, 180)
    return (
        df.withColumn("__cell", F.when(ok, cell(la, lo, bits)))
        .join(F.broadcast(cells), "__cell", "left")
        .withColumn(out, F.coalesce(hit, F.lit(default).cast("string")))
        .drop("__cell", "__cand")
    )


def near_points(left: DataFrame, right: DataFrame, radius_m: float, lat: str = "lat", lon: str = "lon", max_abs_lat: float = 60.0) -> DataFrame:
    """Rows of ``left`` with each row of ``right`` at most ``radius_m`` away, as structs ``left`` and ``right`` and ``distance_m``.

    Structs keep clashing column names of the two inputs apart. Null or wild
    coordinates match nothing.
    """
    bits = bits_for(radius_m, max_abs_lat)

    def clean(df: DataFrame, side: str) -> DataFrame:
        x, y = F.col(lat).cast("double"), F.col(lon).cast("double")
        return df.where(x.between(-90, 90) & y.between(-180, 180)).select(F.struct("*").alias(side), x.alias(f"{side}_lat"), y.alias(f"{side}_lon"))

    a = clean(left, "left").withColumn("cell", F.explode(disc_cells(F.col("left_lat"), F.col("left_lon"), radius_m, bits)))
    b = clean(right, "right").withColumn("cell", cell(F.col("right_lat"), F.col("right_lon"), bits))
    return (
        a.join(b, "cell")
        .withColumn("distance_m", distance_m(F.col("left_lat"), F.col("left_lon"), F.col("right_lat"), F.col("right_lon")))
        .where(F.col("distance_m") <= radius_m)
        .select("left", "right", "distance_m")
    )
