"""Regions from the pixel store equal crops and means of all pixels, and read little."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from fiberlake.operators import pixels
from fiberlake.sources.pixel_store import MOST_BOXES, PixelStore, key_ranges, morton


def plain_key(x, y):
    return sum(((x >> i) & 1) << 2 * i | ((y >> i) & 1) << 2 * i + 1 for i in range(31))


@pytest.fixture(scope="module")
def image(spark):
    n = spark.range(2 * 512 * 512).select((F.col("id") % 2).alias("image_id"), F.lit(0).alias("channel"), (F.shiftright("id", 1) % 512).cast("int").alias("x"), F.shiftright("id", 10).cast("int").alias("y"))
    return n.withColumn("value", F.when(F.col("x") * 3 % 101 == 7, None).otherwise((F.col("x") * 31 + F.col("y") * 17 + F.col("image_id")) % 997).cast("double"))


@pytest.fixture(scope="module")
def store(image):
    s = PixelStore(f"{tempfile.mkdtemp(prefix='spark-store-')}/px", levels=3, block=16, page_rows=1_000)
    s.write(image)
    return s


def scanned(df):
    """Rows that the scan gave to the plan of df, once it has run."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_keys_and_ranges_hold_all_blocks_of_a_box(spark):
    rnd = random.Random(3)
    places = [(rnd.randrange(1 << 31), rnd.randrange(1 << 31)) for _ in range(200)] + [(0, 0), (2**31 - 1, 0)]
    got = spark.createDataFrame(places, "x long, y long").select("x", "y", morton(F.col("x"), F.col("y")).alias("k")).collect()
    assert all(r.k == plain_key(r.x, r.y) for r in got)
    for _ in range(60):
        x0, y0 = rnd.randrange(40), rnd.randrange(40)
        x1, y1 = x0 + rnd.randrange(30), y0 + rnd.randrange(30)
        keys = {plain_key(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
        exact = key_ranges(x0, y0, x1, y1, 10_000)
        assert sum(hi - lo + 1 for lo, hi in exact) == len(keys) and all(any(lo <= k <= hi for lo, hi in exact) for k in keys)
        few = key_ranges(x0, y0, x1, y1)
        assert len(few) <= 16 and all(any(lo <= k <= hi for lo, hi in few) for k in keys)
    assert len(key_ranges(5, 9, 40_000_000, 70_000_000)) <= 16


def test_a_region_equals_the_crop_and_reads_few_pages(spark, image, store):
    boxes = [(0, 100.4, 33.0, 37.2, 20.0), (1, 300.0, 480.0, 60.0, 90.0), (1, 310.0, 490.0, 5.0, 5.0)]
    got = store.read(spark, boxes)
    want = pixels.crop(image, spark.createDataFrame(boxes[:2], "image_id long, x double, y double, width double, height double"))
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count() == 38 * 20 + 60 * 32
    assert "GreaterThanOrEqual(code" in got._jdf.queryExecution().executedPlan().toString()
    # 2,680 pixels of 524,288: the pages that hold their blocks
    assert scanned(got) < 40_000


def test_means_start_from_the_nearest_level(spark, image, store):
    box = [(None, 64.0, 128.0, 128.0, 64.0)]
    assert [store.level_for(box, d) for d in (1, 2, 2.5, 4, 6, 8, 16)] == [0, 1, 0, 2, 1, 3, 3]
    assert store.level_for([(None, 65.0, 128.0, 128.0, 64.0)], 8) == 0
    inside = image.where("x >= 64 and x < 192 and y >= 128 and y < 192")
    for d in (2.0, 2.5, 6.0, 8.0, 16.0):
        rounded = lambda df: sorted((r.image_id, r.x, r.y, r.value and round(r.value, 6)) for r in df.collect())
        assert rounded(store.read(spark, box, d)) == rounded(pixels.downsample(inside, d))
    assert store.read(spark, [(1, 0, 0, None, None)], 8.0).count() == 64 * 64


def test_no_box_empty_boxes_and_too_many(spark, store):
    assert store.read(spark, []).collect() == []
    assert store.read(spark, [(0, 5.0, 5.0, 0.0, 9.0), (0, 9_000.0, 0.0, 5.0, 5.0), (7, 0.0, 0.0, 5.0, 5.0), (0, -9.0, -9.0, 4.0, 4.0)]).collect() == []
    with pytest.raises(ValueError):
        store.read(spark, [(0, 0.0, 0.0, 1.0, 1.0)] * (MOST_BOXES + 1))


def test_an_empty_table_is_a_store_too(spark, image):
    s = PixelStore(f"{tempfile.mkdtemp(prefix='spark-store-')}/px", levels=2)
    s.write(image.where("false"))
    assert s.read(spark, [(None, 0, 0, None, None)], 4.0).collect() == []
