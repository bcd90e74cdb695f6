"""Nearest outlines at any distance, held against all segments."""

import math
import random

from pyspark.sql import functions as F

from fiberlake.operators import boundary

RINGS = "image_id long, annotation_id int, part_id int, vertices array<struct<x double, y double>>"
FIBERS = "image_id long, tile_id int, fiber_id long, angle double, center struct<x double, y double>"


def plain(x, y, ring):
    best = math.inf
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / square)) if square else 0.0
        best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


def test_outlines_at_any_distance_equal_a_search_of_all_segments(spark):
    rnd = random.Random(5)
    ring = {i: [(rnd.uniform(-900, 2_500), rnd.uniform(-900, 2_500)) for _ in range(9)] for i in (1, 2)}
    # a circle around a fibre, an upright line, equal distances
    ring[3] = [(500 + 400 * math.cos(a / 20 * math.pi), 500 + 400 * math.sin(a / 20 * math.pi)) for a in range(40)]
    ring[4] = [(100.0, 0.0), (100.0, 300.0), (100.0, 600.0)]
    fibers = [(i, 0, n, 10.0, (rnd.uniform(-4_000, 6_000), rnd.uniform(-4_000, 6_000))) for i in (1, 2, 3, 4) for n in range(40)]
    fibers += [(3, 0, 99, 10.0, (500.0, 500.0)), (4, 0, 99, 0.0, (900.0, 300.0)), (5, 0, 1, 1.0, (0.0, 0.0)), (1, 0, 98, 1.0, None), (1, 0, 97, 1.0, (math.nan, 5.0)), (1, 0, 96, 1.0, (5.0, math.inf))]
    rings = spark.createDataFrame([(i, 0, 0, v) for i, v in ring.items()], RINGS)
    df = spark.createDataFrame(fibers, FIBERS)
    got = {(r.image_id, r.fiber_id): r.distance_to_boundary for r in boundary.nearest_boundary(df, rings, 60.0, beyond=True).collect()}
    near = {(r.image_id, r.fiber_id): r.distance_to_boundary for r in boundary.nearest_boundary(df, rings, 60.0).collect()}
    assert len(got) == len(fibers)
    for i, _, n, _, at in fibers:
        if at is None or i not in ring or not all(map(math.isfinite, at)):
            assert got[i, n] is None
            continue
        want = plain(*at, ring[i])
        assert abs(got[i, n] - want) < 1e-6 and (near[i, n] is None) == (want > 60.0)


def test_cells_grow_with_length_and_not_with_area(spark):
    line = spark.createDataFrame([(0.0, 0.0, 10_000.0, 9_000.0), (5.0, 5.0, 5.0, 9_000.0)], "ax double, ay double, bx double, by double")
    for grown in (False, True):
        n = {r.bx: r.n for r in boundary.crossed_cells(line, 10.0, grown).groupBy("bx").agg(F.count(F.lit(1)).alias("n")).collect()}
        # the box has 900,000 cells
        assert n[10_000.0] < 8_000 and n[5.0] < 2_800
    rnd = random.Random(9)
    places = [tuple(rnd.uniform(0, 300) for _ in range(4)) for _ in range(20)]
    cells = {tuple(r) for r in boundary.crossed_cells(spark.createDataFrame(places, line.schema), 10.0, True).select("ax", "_gx", "_gy").collect()}
    for ax, ay, bx, by in places:
        for _ in range(200):
            t, turn, far = rnd.random(), rnd.uniform(0, 6.3), rnd.uniform(0, 10)
            x, y = ax + t * (bx - ax) + far * math.cos(turn), ay + t * (by - ay) + far * math.sin(turn)
            assert (ax, math.floor(x / 10), math.floor(y / 10)) in cells


def test_no_outline_at_all(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.0, (1.0, 1.0))], FIBERS)
    assert [r.distance_to_boundary for r in boundary.nearest_boundary(df, spark.createDataFrame([], RINGS), 10.0, beyond=True).collect()] == [None]
