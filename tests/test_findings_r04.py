"""Queries on images where a reviewer's larger copies had failed: pixels were sent to all tasks through the driver."""

import math

from pyspark.sql import Row
from pyspark.sql import functions as F

from fiberlake.operators import detect, fibers, rounds, tiles, tuning
from fiberlake.plans import fiber_queries, pixel_queries
from fiberlake.sources import fixtures as fx


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sent(df) -> list[str]:
    """What is below each broadcast in the plan."""
    lines, out = plan(df).splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-|*()0123456789"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((k for k in range(i + 1, len(lines)) if depth(lines[k]) <= depth(line)), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def pixels_of(spark, n=120, side=6):
    """Pixels that are exploded from few rows, which Spark takes for a table smaller than that of their statistics."""
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    px = spark.range(n).select(F.col("id").alias("image_id")).withColumn("x", every).withColumn("y", every)
    return px.select("image_id", F.lit(0).alias("channel"), "x", "y", (F.col("x") * 7 + F.col("y") * F.col("image_id") % 11).cast("double").alias("value"))


def test_pixels_are_not_sent_to_meet_their_statistics(spark, monkeypatch):
    """F2 to F5, F8 to F10: the statistics' table was thought to be larger than the pixels."""
    px = pixels_of(spark)
    gray = pixel_queries.gray_of(px)
    assert sent(gray) and not any("Range" in x for x in sent(gray))
    few = sorted(map(tuple, gray.collect()))
    monkeypatch.setattr(rounds, "SENT", 10)
    many = pixel_queries.gray_of(px)
    assert not sent(many) and sorted(map(tuple, many.collect())) == few
    assert not sent(pixel_queries.gray_lines(spark, "/root/testdata/sf0.001"))


def test_pixels_are_not_sent_to_meet_their_tiles(spark, monkeypatch):
    """nor do pixels go through the driver to meet tiles, levels and thresholds."""
    gray = pixels_of(spark).select("image_id", "x", "y", F.col("value").cast("int").alias("g"))
    boxes = rounds.written(spark.range(120).selectExpr("id as image_id", "0 as x", "0 as y", "6 as width", "6 as height", "1.0D as downsample"))
    cut_up = tiles.make_tiles(boxes, core=3, overlap=1)
    dense = tiles.dense_tiles(gray, cut_up)
    assert sent(dense) and not any("Range" in x for x in sent(dense))
    few = sorted(map(tuple, dense.collect()))
    monkeypatch.setattr(rounds, "SENT", 10)
    many = tiles.dense_tiles(gray, cut_up)
    assert not any("Range" in x for x in sent(many)) and sorted(map(tuple, many.collect())) == few and len(few) == 120 * 4 * 16


def test_pixels_that_are_dealt_out_by_image_stay_there(spark):
    """pixels were shuffled to be thinned in blocks, since their keys became one struct."""
    gray = pixel_queries.gray_lines(spark, "/root/testdata/sf0.001")
    exchanges = [x for x in plan(detect.setting_parts(gray, [(None, 40, 120)])).splitlines() if "Exchange" in x]
    assert not any("_bx" in x for x in exchanges)


def test_drawn_lines_are_the_planted_ones(spark):
    """The images say what they said when a function went over their lines for each pixel; some images lack lines."""
    d = "/root/testdata/sf0.001"
    rows = [r for r in fx.drawn_lines(spark, d).collect()]

    def lit(r, x, y):
        i = x - r.x0 if r.dir == 0 else r.y0 - y if r.dir == 3 else y - r.y0
        off = y - r.y0 if r.dir == 0 else x - r.x0 - (0 if r.dir == 1 else i)
        return 0 <= i < r.n and abs(off) <= 1

    of = {}
    for r in rows:
        of.setdefault(r.image_id, []).append(r)
    want = {(i, x, y): 200.0 if any(lit(r, x, y) for r in of[i]) else float((x * 7 + y * 13) % 3) for i in of for x in range(fx.SIDE) for y in range(fx.SIDE)}
    assert {(r.image_id, r.x, r.y): r.value for r in fx.px_lines(spark, d).collect()} == want


def test_each_axis_of_a_search_acts_on_the_fibres(spark):
    """seed, bend and link had no effect on what a combo found."""
    bent = [[(0, 0), (40, 0)], [(43, 0), (43 + 30 * math.cos(0.7), 30 * math.sin(0.7))]]  # 3 apart, a turn of 40 degrees
    apart = [[(0, 100), (40, 100)], [(50, 100), (50 + 30 * math.cos(0.35), 100 + 30 * math.sin(0.35))]]  # 10 apart, a turn of 20 degrees
    beside = [[(0, 200), (40, 200)], [(2, 206), (38, 206)], [(4, 212), (36, 212)]]  # centres 6 apart
    at = [(1, 0, i, [tuple(map(float, p)) for p in line]) for i, line in enumerate(bent + apart + beside)] + [(1, 1, 0, [(0.0, 0.0), (40.0, 0.0)])]
    lines = fibers.measured(spark.createDataFrame(at, "image_id long, setting int, fiber_id long, points array<struct<x: double, y: double>>")).withColumn("width", F.lit(None).cast("double"))
    axes = [(v, s, b, k) for v in (20.0, 90.0) for s in (2.0, 8.0, 13.0) for b in (30.0, 50.0) for k in (10.0, 25.0)]
    combos = [Row(combo_id=i, level=v, seed=s, bend=b, link=k) for i, (v, s, b, k) in enumerate(axes)]
    got = tuning.combined(lines, ["image_id"], [20.0, 90.0], combos).select("combo_id", F.size("points").alias("n"), F.round("length_arc").alias("long")).collect()
    for i, (v, s, b, k) in enumerate(axes):
        longs = [40.0]
        if v == 20.0:
            longs = ([73.0] if b == 50.0 else [40.0, 30.0]) + ([80.0] if k == 25.0 else [40.0, 30.0]) + {2.0: [40.0, 36.0, 32.0], 8.0: [40.0, 32.0], 13.0: [40.0]}[s]
        assert sorted(r.long for r in got if r.combo_id == i) == sorted(longs), axes[i]
    assert tuning.combined(lines, ["image_id"], [], []).count() == 0


def test_scores_of_a_search_differ_by_seed_and_link(spark):
    """combos of one sensitivity had one score."""
    r = fiber_queries.suggest(spark, "/root/testdata/sf0.001").collect()
    seen = {tuple(x.combo_key.split("_")): x.score for x in r}
    differ = lambda k: any(p[:k] + p[k + 1 :] == q[:k] + q[k + 1 :] and seen[p] != seen[q] for p in seen for q in seen)
    assert differ(0) and differ(3)
