"""Curved fibres from noisy pixels: recall of planted curves, spacing of seeds, order of paths."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fiberlake.operators import pixels, tracing
from fiberlake.plans import fiber_queries, pixel_queries
from fiberlake.sources import fixtures as fx

SMALL = "/root/testdata/sf0.001"


def to_path(x, y, points):
    """Distance of a place to a polyline."""
    best = math.inf
    for p, q in zip(points, points[1:]):
        dx, dy = q[0] - p[0], q[1] - p[1]
        t = max(0, min(1, ((x - p[0]) * dx + (y - p[1]) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(p[0] + t * dx - x, p[1] + t * dy - y))
    return best


def test_planted_curves_are_traced(spark):
    gray = pixel_queries.gray_of(fx.px_curves(spark, SMALL)).select("image_id", "x", "y", "g", F.lit(fx.CURVED).alias("width"), F.lit(fx.CURVED).alias("height"))
    found = tracing.trace(pixels.gaussian_blur(gray, 1.0), F.lit(110)).collect()
    curves = {}
    for r in fx.planted_curves(spark, SMALL).collect():
        curves.setdefault((r.image_id, r.line_id), []).append((r.x, r.y))
    paths = {}
    for f in found:
        paths.setdefault(f.image_id, []).append([(p.x, p.y) for p in f.points])
    share = {k: sum(any(to_path(x, y, p) <= 2 for p in paths.get(k[0], [])) for x, y in c) / len(c) for k, c in curves.items()}
    assert sum(v >= 0.9 for v in share.values()) >= 0.9 * len(share), share
    # few pieces for each curve, curved ones, no fibre off a curve, widths near the five pixels drawn
    assert len(found) <= 1.5 * len(curves)
    assert max(f.length_arc for f in found) > 60 and min(f.straightness for f in found) < 0.99
    off = [p for f in found for p in [(q.x, q.y) for q in f.points] if min(abs(y - p[1]) + abs(x - p[0]) for k, c in curves.items() if k[0] == f.image_id for x, y in c) > 4]
    assert not off
    assert all(3 <= f.width <= 7 for f in found)
    assert all(p != q for f in found for p, q in zip(f.points, f.points[1:]))


@pytest.mark.parametrize("box", [1, 3])
def test_seeds_are_spaced(spark, box):
    rng = random.Random(box)
    values = {(x, y): (4 if y == 10 else rng.randint(0, 5)) for x in range(40) for y in range(24)}
    df = spark.createDataFrame([(0, x, y, v) for (x, y), v in values.items()], "image_id long, x int, y int, distance int")
    got = {(r.x, r.y) for r in tracing.spaced_maxima(df, box, 3).collect()}
    around = lambda x, y: [values.get((x + i, y + j), 0) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    tops = [(x, y) for (x, y), v in values.items() if v >= 3 and v == max(around(x, y))]
    want = []
    for x, y in sorted(tops, key=lambda p: (-values[p], -((p[0] * 7_919 + p[1] * 104_729) % 65_537), p[1], p[0])):
        if all(abs(x - a) > box or abs(y - b) > box for a, b in want):
            want.append((x, y))
    assert got == set(want) and len(want) > 8


def test_a_long_plateau_keeps_seeds_all_along(spark):
    df = spark.range(300).selectExpr("0L as image_id", "cast(id as int) as x", "5 as y", "3 as distance")
    xs = sorted(r.x for r in tracing.spaced_maxima(df, 4, 2).collect())
    assert all(5 <= b - a <= 9 for a, b in zip(xs, xs[1:])) and xs[0] <= 4 and xs[-1] >= 295


def test_paths_through_a_crossing_and_around_a_ring(spark):
    """Two lines that cross go straight on; a ring is one path of all its seeds."""
    rows = [(0, i, 10.0 + 5 * i, 50.0, 1.0, 0.0) for i in range(9)] + [(0, 20 + i, 30.0, 29.0 + 5 * i, 0.0, 1.0) for i in range(9)]
    ring = [(1, i, 100 + 20 * math.cos(math.radians(15 * i)), 100 + 20 * math.sin(math.radians(15 * i)), -math.sin(math.radians(15 * i)), math.cos(math.radians(15 * i))) for i in range(24)]
    seeds = spark.createDataFrame(rows + ring, "image_id long, seed_id long, x double, y double, ux double, uy double")
    links = tracing.match_ends(tracing.facing_ends(seeds, 7.0, 40.0).withColumn("same_tile", F.lit(False)))
    placed = tracing.ordered_chains(links).collect()
    chains = {}
    for r in sorted(placed, key=lambda r: r.place):
        chains.setdefault((r.image_id, r.chain), []).append(r.fiber_id)
    assert sorted(map(len, chains.values())) == [9, 9, 24]
    for (image, _), ids in chains.items():
        assert image == 1 or ids == sorted(ids) or ids == sorted(ids, reverse=True)


def test_nothing_to_trace(spark):
    gray = spark.range(64).selectExpr("0L as image_id", "cast(id % 8 as int) as x", "cast(id / 8 as int) as y", "5 as g", "8 as width", "8 as height")
    assert tracing.trace(gray, F.lit(100)).collect() == []
    assert fiber_queries.QUERIES["trace_fibers"][1] is None
