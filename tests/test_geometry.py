"""Hand-made geometry with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from fiberlake.functions import geometry as g
from fiberlake.operators import boundary, detect, fibers, pixels, seams, tiles, tuning

SCHEMA = "image_id long, tile_id int, fiber_id long, points array<struct<x: double, y: double>>, width double, tacs string"


def make(spark, *rows):
    """(tile, id, points[, width])"""
    full = [(0, r[0], r[1], [(float(x), float(y)) for x, y in r[2]], float(r[3]) if len(r) > 3 else None, None) for r in rows]
    return fibers.measured(spark.createDataFrame(full, SCHEMA))


@pytest.mark.parametrize("points,arc,angle,straight", [([(0, 0), (3, 4)], 5, 126.869898, 1), ([(0, 0), (3, 4), (3, 10)], 11, 106.699244, math.hypot(3, 10) / 11), ([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], 4, 0, 0)])
def test_metrics(spark, points, arc, angle, straight):
    r = make(spark, (0, 1, points)).first()
    assert r.length_arc == pytest.approx(arc) and r.angle == pytest.approx(angle, abs=1e-5) and r.straightness == pytest.approx(straight)
    assert (r.center.x, r.center.y) == points[len(points) // 2]


def test_angles_stay_in_range(spark):
    rows = spark.range(-720, 720).select(g.axis_angle(F.cos(F.radians("id")), F.sin(F.radians("id"))).alias("a"), g.acute_difference(F.col("id").cast("double"), F.lit(10.0)).alias("d")).collect()
    assert all(0 <= r.a < 180.0000001 and 0 <= r.d <= 90 for r in rows)


def test_duplicates(spark):
    two = make(spark, (0, 1, [(0, 0), (10, 0), (20, 0)]), (1, 2, [(0, 2), (10, 2), (20, 2)]))
    assert [r.fiber_id for r in seams.dedup_fibers(two).collect()] == [1]
    crossing = make(spark, (0, 1, [(0, 0), (10, 0), (20, 0)]), (1, 2, [(10, -10), (10, 0), (10, 10)]))
    assert seams.dedup_fibers(crossing).count() == 2
    # a chain: the middle one is worse than the first and better than the last, which therefore stays
    chain = make(spark, (0, 1, [(0, 0), (10, 0), (20.2, 0)]), (1, 2, [(0, 3), (10, 3), (20.1, 3)]), (0, 3, [(0, 6), (10, 6), (20, 6)]))
    assert sorted(r.fiber_id for r in seams.dedup_fibers(chain).collect()) == [1, 3]
    assert sorted(r.fiber_id for r in seams.dedup_once(chain).collect()) == [1]
    once = seams.dedup_fibers(chain)
    assert sorted(map(str, seams.dedup_fibers(once).collect())) == sorted(map(str, once.collect()))


def test_stitching(spark):
    gap = make(spark, (0, 1, [(0, 0), (10, 0)], 3), (1, 2, [(14, 0), (24, 0)], 5))
    r = seams.stitch_fibers(gap).collect()
    assert [(x.fiber_id, x.tile_id, x.length_arc, x.width) for x in r] == [(1, 0, 24.0, 3.0)]
    assert seams.stitch_fibers(make(spark, (0, 1, [(0, 0), (10, 0)]), (0, 2, [(14, 0), (24, 0)]))).count() == 2


def test_stitching_reversed_pieces_and_shared_vertices(spark):
    f = make(spark, (0, 1, [(10, 0), (0, 0)]), (1, 2, [(20, 0), (10, 0)]), (2, 3, [(24, 0), (34, 0)]), (5, 9, [(100, 100), (120, 100)]))
    r = sorted(seams.stitch_fibers(f).collect(), key=lambda x: x.fiber_id)
    assert [x.fiber_id for x in r] == [1, 9]
    assert [(p.x, p.y) for p in r[0].points] == [(0, 0), (10, 0), (20, 0), (24, 0), (34, 0)] and r[0].length_arc == 34


def test_stitching_a_cycle_and_a_contest(spark):
    corner = [(0, 0), (10, 0), (20, 0)], [(22, 1), (23, 10), (22, 19)], [(20, 21), (10, 22), (0, 21)], [(-2, 19), (-3, 10), (-2, 1)]
    ring = make(spark, *[(i, i, p) for i, p in enumerate(corner)])
    r = seams.stitch_fibers(ring, tol=6, angle_tol=100).collect()
    assert len(r) == 1 and len(r[0].points) == 12
    contest = make(spark, (0, 1, [(0, 0), (10, 0)]), (1, 2, [(12, 0), (30, 0)]), (2, 3, [(14, 0), (40, 0)]))
    assert sorted(x.fiber_id for x in seams.stitch_fibers(contest).collect()) == [1, 3]


def test_matching_order(spark):
    f = make(spark, (0, 1, [(0, 0), (10, 0), (20, 0)]))
    lines = spark.createDataFrame([(0, 5, [(0.0, 1.0), (20.0, 1.0)]), (0, 6, [(0.0, 0.0), (20.0, 0.0)])], "image_id long, line_id long, points array<struct<x: double, y: double>>")
    m = tuning.match_ground_truth(tuning.match_candidates(f, lines)).collect()
    assert [(r.line_id, r.fiber_id) for r in m] == [(5, 1)]


def test_tiles_partition_the_region(spark):
    regions = spark.createDataFrame([(0, 0, 0, 2000, 1500, 1.0), (1, 5, 5, 100, 100, 2.0), (2, 0, 0, 99_999, 80_000, 1.0)], "image_id long, x int, y int, width int, height int, downsample double")
    t = tiles.make_tiles(regions)
    area = {r.image_id: (r.a, r.n) for r in t.groupBy("image_id").agg(F.sum((F.col("core_x1") - F.col("core_x0")).cast("long") * (F.col("core_y1") - F.col("core_y0"))).alias("a"), F.count(F.lit(1)).alias("n")).collect()}
    assert area[0] == (3_000_000, 6) and area[1] == (2_500, 1) and area[2][0] == 99_999 * 80_000 and area[2][1] <= 64
    p = spark.range(2000).select(F.lit(0).cast("long").alias("image_id"), F.col("id").cast("int").alias("x"), F.lit(750).alias("y"))
    n = [r["count"] for r in tiles.assign_tiles(p, t.where("image_id = 0")).groupBy("x").count().collect()]
    assert len(n) == 2000 and set(n) <= {1, 2, 4}


def test_polygon_fill_is_even_odd(spark):
    ring = [(2.3, 1.1), (17.8, 3.2), (12.5, 14.9), (9.1, 6.0), (4.4, 13.7)]
    rings = spark.createDataFrame([(0, 0, 0, [tuple(map(float, v)) for v in ring])], "image_id long, annotation_id int, part_id int, vertices array<struct<x: double, y: double>>")
    box = spark.createDataFrame([(0, 0, 0, 20, 16, 1.0)], "image_id long, x int, y int, width int, height int, downsample double")
    inside = lambda x, y: sum((ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) % 2 == 1
    want = {(x, y) for x in range(20) for y in range(16) if inside(x + 0.5, y + 0.5)}
    assert {(r.x, r.y) for r in boundary.rasterize_polygon(rings, box).collect()} == want


def test_distance_to_background(spark):
    from random import Random

    rnd = Random(1)
    cells = {(x, y): rnd.random() < 0.8 for x in range(17) for y in range(23)}
    df = spark.createDataFrame([(0, x, y, v) for (x, y), v in cells.items()], "image_id long, x int, y int, inside boolean")
    want = {k: min(abs(k[0] - a) + abs(k[1] - b) for (a, b), v in cells.items() if not v) for k in cells}
    assert {(r.x, r.y): r.distance for r in pixels.distance_transform(df).collect()} == want


def test_hough_finds_lines_and_bridges_gaps(spark):
    pts = [(x, 20) for x in range(10, 60) if not 30 <= x < 34] + [(x, x) for x in range(70, 120)]
    df = spark.createDataFrame([(0, x, y) for x, y in pts], "image_id long, x int, y int")
    s = detect.hough_segments(df, ["image_id"]).collect()
    ends = {(r.ax, r.ay, r.bx, r.by) for r in s} | {(r.bx, r.by, r.ax, r.ay) for r in s}
    assert (10, 20, 59, 20) in ends and (70, 70, 119, 119) in ends


def test_hysteresis_follows_weak_edges(spark):
    rows = [(0, x, 5, 60, x == 3) for x in range(3, 12)] + [(0, 30, 30, 60, False)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, magnitude int, strong boolean")
    assert sorted(r.x for r in detect.hysteresis(df).collect()) == list(range(3, 12))


def test_a_failing_tracer_gives_a_status_row(spark):
    import pandas as pd

    def tracer(key, pdf):
        if key[1] == 1:
            raise ValueError("too dense")
        return pd.DataFrame({"image_id": [key[0]], "tile_id": [key[1]], "n": [len(pdf)], "error": [None]})

    df = spark.createDataFrame([(0, t, x, 0, 9) for t in (0, 1) for x in range(4)], "image_id long, tile_id int, x int, y int, g int")
    got = {r.tile_id: (r.n, r.error) for r in detect.detect(df, ["image_id", "tile_id"], tracer, "image_id long, tile_id int, n double, error string").collect()}
    assert got[0] == (4, None) and got[1][1] == "too dense"


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_results_do_not_depend_on_partitions(spark, partitions):
    f = make(spark, *[(i % 3, i, [(10 * i, i % 5), (10 * i + 7, i % 5)]) for i in range(40)]).repartition(partitions)
    r = sorted((x.fiber_id, round(x.length_arc, 6)) for x in seams.stitch_fibers(f).collect())
    if not hasattr(test_results_do_not_depend_on_partitions, "first"):
        test_results_do_not_depend_on_partitions.first = r
    assert r == test_results_do_not_depend_on_partitions.first and len(r) < 40


def test_images_and_annotations_are_read(spark, tmp_path):
    from fiberlake.sources.pixels import read_annotations

    (tmp_path / "a.json").write_text('{"image_id": 3, "id": 1, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[4,0],[4,4]]],[[[9,9],[12,9],[12,12]]]]}, "properties": {"classification": {"name": "Tumour"}, "name": "t"}}\n{"image_id": 3, "id": 2, "geometry": {"type": "Polygon", "coordinates": [[[1,1],[2,1],[2,2]]]}, "properties": {}}\n')
    rows = sorted((r.annotation_id, r.part_id, len(r.vertices), r["class"]) for r in read_annotations(spark, str(tmp_path)).collect())
    assert rows == [(1, 0, 3, "Tumour"), (1, 1, 3, "Tumour"), (2, 0, 3, None)]


def test_line_annotations_are_truth_lines(spark, tmp_path):
    from fiberlake.sources.pixels import read_annotations, read_truth_lines

    (tmp_path / "a.json").write_text('{"image_id": 3, "id": 7, "geometry": {"type": "LineString", "coordinates": [[1,2],[3,4],[5,5]]}, "properties": {"name": "l"}}\n{"image_id": 3, "id": 8, "geometry": {"type": "LineString", "coordinates": [[1,2]]}, "properties": {}}\n{"image_id": 3, "id": 9, "geometry": {"type": "Polygon", "coordinates": [[[1,1],[2,1],[2,2]]]}, "properties": {}}\n{"image_id": 3, "id": 10, "geometry": null}\n')
    rows = [(r.image_id, r.line_id, r.name, [(p.x, p.y) for p in r.points]) for r in read_truth_lines(spark, str(tmp_path)).collect()]
    assert rows == [(3, 7, "l", [(1, 2), (3, 4), (5, 5)])] and read_annotations(spark, str(tmp_path)).count() == 1


def test_an_image_becomes_pixel_rows(spark, tmp_path, monkeypatch):
    import struct
    import zlib

    from fiberlake.sources import pixels as source

    value = lambda x, y, c: (x * 40 + y * 7 + c * 90) % 256
    lines = b"".join(b"\0" + bytes(value(x, y, c) for x in range(5) for c in range(3)) for y in range(4))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
    got = {(r.x, r.y, r.channel): r.value for r in source.read_pixels(spark, str(tmp_path), "image").collect()}
    assert got == {(x, y, 2 - c): value(x, y, c) for x in range(5) for y in range(4) for c in range(3)}


def test_full_boxes_end_with_the_image(spark):
    regions = spark.createDataFrame([(0, 0, 0, 2000, 700, 1.0, 1500, 600)], "image_id long, x int, y int, width int, height int, downsample double, image_width int, image_height int")
    got = [(r.tile_id, r.full_x, r.full_w, r.full_h) for r in tiles.make_tiles(regions, core=500, overlap=50, max_tiles=None).where("core_y0 = 0").orderBy("tile_id").collect()]
    assert got == [(0, 0, 550, 400), (1, 450, 600, 400), (2, 950, 550, 400), (3, 1450, 50, 400)]


def test_objects_are_saved_by_image(spark, tmp_path):
    f = make(spark, (0, 1, [(0, 0), (10, 0)]), (0, 2, [(0, 5), (9, 5)])).withColumn("angle_to_tangent", F.lit(None).cast("double")).withColumn("distance_to_boundary", F.lit(None).cast("double"))
    box = spark.createDataFrame([(0, 100, 50, 2.0, None)], "image_id long, x int, y int, downsample double, pixel_size_um double")
    o = fibers.to_objects(f, box)
    fibers.save_objects(o, f"{tmp_path}/o")
    fibers.save_objects(o.where("fiber_id = 1"), f"{tmp_path}/o")
    back = spark.read.parquet(f"{tmp_path}/o").collect()
    assert [r.name for r in back] == ["Fiber 1"] and back[0].measurements["Length (px)"] == 20.0 and (back[0].points[1].x, back[0].points[1].y) == (120, 50)
    fibers.save_geojson(o, f"{tmp_path}/g")
    assert spark.read.json(f"{tmp_path}/g").count() == 2


def test_a_joined_piece_goes_on_with_any_tile(spark):
    """Pieces of tiles 0, 1, 1 in a row are one fibre: the first joint takes the second piece out of its tile."""
    f = make(spark, (0, 1, [(0, 0), (10, 0)]), (1, 2, [(12, 0), (20, 0)]), (1, 3, [(22, 0), (30, 0)]), (2, 4, [(100, 50), (110, 50)]), (2, 5, [(112, 50), (120, 50)]))
    r = sorted(seams.stitch_fibers(f).collect(), key=lambda x: x.fiber_id)
    assert [(x.fiber_id, x.length_arc) for x in r] == [(1, 30.0), (4, 10.0), (5, 8.0)]


def test_scores_of_images_without_fibres(spark):
    f = make(spark, (0, 1, [(0, 0), (10, 0), (20, 0)])).withColumn("combo_id", F.lit(0))
    lines = spark.createDataFrame([(0, 1, [(0.0, 1.0), (20.0, 1.0)]), (5, 2, [(0.0, 1.0), (20.0, 1.0)])], "image_id long, line_id long, points array<struct<x double, y double>>")
    keys = ["image_id", "combo_id"]
    every = spark.createDataFrame([(i, c) for i in (0, 5) for c in (0, 1)], "image_id long, combo_id int")
    m = tuning.match_ground_truth(tuning.match_candidates(f, lines, keys=keys), keys)
    got = {(r.image_id, r.combo_id): (r.n, r.n_gt, r.matched, r.score, r.recall) for r in tuning.score_supervised(f, lines, m, "count", keys=keys, scored=every).collect()}
    assert got == {(0, 0): (1, 1, 1, 1.0, 1.0), (0, 1): (0, 1, 0, 0.0, 0.0), (5, 0): (0, 1, 0, 0.0, 0.0), (5, 1): (0, 1, 0, 0.0, 0.0)}
    covered = spark.createDataFrame([(0, 0.5), (7, 0.25), (8, None)], "image_id long, coverage double")
    plain = {r.image_id: (r.n, r.score) for r in tuning.score_unsupervised(f, covered, 128, 128).collect()}
    assert plain == {0: (1, 0.9), 7: (0, 0.25), 8: (0, -1.0)}
