"""Reports and exported tiles as files; sizes by image; preview colours."""

import glob
import tempfile

from pyspark.sql import functions as F

from fiberlake.functions import geometry as g
from fiberlake.operators import boundary, fibers, tiles, tuning
from fiberlake.plans import fiber_queries


def test_report_has_one_header(spark, sf):
    path = f"{tempfile.mkdtemp(prefix='spark-report-')}/report"
    rows = fiber_queries.tuning_row(spark, sf).limit(5)
    fibers.append_measurements(rows, path)
    fibers.append_measurements(rows.withColumn("image", F.lit("a\tb\nc")), path)
    lines = [x for f in glob.glob(f"{path}/part-*") for x in open(f).read().splitlines()]
    header = [x for x in lines if x.startswith("timestamp\t")]
    assert len(header) == 1 and len(lines) == 11 and all(x.count("\t") == header[0].count("\t") for x in lines)
    back = fibers.read_measurements(spark, path)
    assert back.columns == header[0].split("\t") and back.columns[1:] == rows.drop("area_id").columns
    assert back.where("image = 'a b c'").count() == 5
    key = "score"
    assert sorted(r[key] for r in back.where("image <> 'a b c'").collect()) == sorted(str(r[key]) for r in rows.collect())


def test_exported_tiles_bear_their_names(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-tiles-')}/tiles"
    gray = spark.range(2 * 40 * 30).selectExpr("id div 1200 as image_id", "cast(id % 40 as int) as x", "cast(id % 1200 div 40 as int) as y", "cast(id % 251 as int) as g")
    regions = spark.createDataFrame([(i, 0, 0, 40, 30, 1.5) for i in (0, 1)], "image_id long, x int, y int, width int, height int, downsample double").withColumn("downsample", F.lit(1.0))
    cut_up = tiles.make_tiles(regions, core=20, overlap=4)
    names = {r.image_id: r.file_name for r in tiles.export_tile(gray, cut_up, 1, path, F.lit(1.5), 2).collect()}
    assert set(names.values()) == {"fiberlake_tile_x16_y0_w24_h19_ds1p5_ch2.parquet"} and set(names) == {0, 1}
    back = spark.read.parquet(path)
    assert {r.file_name for r in back.select("file_name").distinct().collect()} == set(names.values())
    want = {(i, x, y, (i * 1200 + y * 40 + x) % 251) for i in (0, 1) for x in range(16, 40) for y in range(19)}
    assert {(r.image_id, r.x, r.y, r.g) for r in back.collect()} == want


def test_sizes_of_each_image(spark):
    line = "array(named_struct('x', 2D, 'y', 2D), named_struct('x', 60D, 'y', 2D))"
    f = spark.range(2).selectExpr("id as image_id", "0 as tile_id", "id as fiber_id", f"{line} as points", "cast(20 + id * 20 as int) as w", "10 as h")
    px = boundary.rasterize_fibers(f, "w", "h", 3)
    assert {r.image_id: r.m for r in px.groupBy("image_id").agg(F.max("x").alias("m")).collect()} == {0: 19, 1: 39}
    for i, w in ((0, 20), (1, 40)):
        assert px.where(f"image_id = {i}").exceptAll(boundary.rasterize_fibers(f.where(f"image_id = {i}"), w, 10, 3)).count() == 0
    many = fibers.measured(spark.range(60).selectExpr("id % 2 as image_id", "0 as tile_id", "id as fiber_id", f"{line} as points"))
    covered = spark.createDataFrame([(0, 0.5, 100, 100), (1, 0.5, 1000, 1000)], "image_id long, coverage double, w int, h int")
    got = {r.image_id: r.runaway for r in tuning.score_unsupervised(many, covered, "w", "h").collect()}
    assert got == {0: 0.5, 1: 0.0}


def test_preview_colours(spark):
    r = spark.createDataFrame([("TACS-3",), ("other",), (None,)], "t string").select("t", g.tacs_rgb(F.col("t")).alias("o"), g.tacs_rgb(F.col("t"), preview=True).alias("p")).collect()
    assert [(x.o, x.p) for x in r] == [("255,0,0", "255,0,0"), ("128,128,128", "0,255,0"), ("128,128,128", "0,255,0")]
