"""Nearest-rank percentiles of images of any size, by passes of bucket counts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fiberlake.operators import pixels


def nearest(values, q):
    return sorted(values)[math.floor(q * (len(values) - 1) + 0.5)]


def images():
    rng = random.Random(11)
    yield [rng.gauss(0, 1) for _ in range(4_000)]
    yield [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(4_000)]
    yield [rng.choice([0.0, 1.0, 7.5]) for _ in range(3_000)]
    yield [5.0] * 2_500
    yield [-1.7e308, 1.7e308] * 400 + [rng.random() * 5e-324 * 2**20 for _ in range(1_500)]
    yield [1.0 + k * 2.0**-52 for k in range(2_000)]
    yield [rng.random() for _ in range(30)]
    yield [3.0]


@pytest.mark.parametrize("ordered", [50, 200_000])
def test_exact_at_any_size(spark, ordered):
    given = dict(enumerate(images()))
    df = spark.createDataFrame([(i, 0, v) for i, vs in given.items() for v in vs] + [(0, 0, float("nan")), (0, 0, None), (0, 0, float("inf"))], "image_id long, channel int, value double").repartition(6)
    values = df.where(pixels.FINITE(F.col("value")))
    rows = {r.image_id: r for r in pixels.order_statistics(values, ["image_id", "channel"], {"a": 0.0, "b": 0.2, "c": 0.995, "d": 1.0}, ordered).collect()}
    assert set(rows) == set(given)
    for i, vs in given.items():
        r = rows[i]
        assert (r.n, r.lo, r.hi) == (len(vs), min(vs), max(vs))
        assert (r.a, r.b, r.c, r.d) == tuple(nearest(vs, q) for q in (0.0, 0.2, 0.995, 1.0)), i


def test_large_image_is_never_ordered_as_a_whole(spark):
    """A float image of 3 million distinct values: the largest window holds a bucket, and the answer is exact."""
    df = spark.range(3_000_000).select(F.lit(0).alias("image_id"), F.lit(0).alias("channel"), (F.pmod(F.col("id") * 1_000_003, F.lit(3_000_000)) / 7.0).alias("value"))
    r = pixels.channel_stats(df, ordered=20_000).first()
    assert (r.n, r.lo, r.hi) == (3_000_000, 0.0, 2_999_999 / 7.0)
    assert r.threshold == math.floor(0.8 * 2_999_999 + 0.5) / 7.0 and r.norm_hi == math.floor(0.995 * 2_999_999 + 0.5) / 7.0


def test_no_values(spark):
    assert pixels.channel_stats(spark.createDataFrame([(0, 0, float("nan"))], "image_id long, channel int, value double")).collect() == []
