"""Pixel operators on long rows (image_id, channel, x, y, value); every one works on all images at once."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiberlake.functions.geometry import half_up
from fiberlake.operators.rounds import Rounds, cut, dealt, written

FINITE = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def crop(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """Pixels inside each region's box: origin floored, far side ceiled. regions: image_id, x, y, width, height (null width: the whole image)."""
    r = regions.select("image_id", F.floor("x").alias("_x0"), F.floor("y").alias("_y0"), F.ceil(F.col("x") + F.col("width")).alias("_x1"), F.ceil(F.col("y") + F.col("height")).alias("_y1"))
    whole = F.col("_x1").isNull()
    inside = (F.col("x") >= F.col("_x0")) & (F.col("x") < F.col("_x1")) & (F.col("y") >= F.col("_y0")) & (F.col("y") < F.col("_y1"))
    return pixels.join(r, "image_id").where(whole | inside).select(*pixels.columns)


def default_downsample(width: Column, height: Column, longest: int = 1200) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(width, height) / F.lit(longest)))


def search_downsample(width: int, height: int, most: int = 640) -> float:
    """Grows by half until the longest side fits."""
    d = 1.0
    while max(width, height) / d > most:
        d *= 1.5
    return d


def downsample(pixels: DataFrame, d: float) -> DataFrame:
    """Mean of the pixels that fall in a cell of d x d."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(d))).cast("int").alias(c)
    return pixels.groupBy("image_id", "channel", cell("x"), cell("y")).agg(F.avg("value").alias("value"))


def select_channel(pixels: DataFrame, channel: int) -> DataFrame:
    """One band; an index outside is clamped to the image's own bands."""
    bands = pixels.groupBy("image_id").agg(F.max("channel").alias("_top"))
    wanted = F.least(F.greatest(F.lit(channel), F.lit(0)), F.col("_top"))
    return pixels.join(bands, "image_id").where(F.col("channel") == wanted).select(*pixels.columns)


def to_gray(pixels: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """g: the value on 0-255; the factor is formed first, since ties depend on it."""
    factor = F.lit(255.0) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    value = F.when(FINITE(F.col("value")), F.col("value")).otherwise(lo)
    return pixels.withColumn("g", F.greatest(F.lit(0), F.least(F.lit(255), half_up((value - lo) * factor))).cast("int"))


def to_gray_robust(pixels: DataFrame, bins: int = 2048) -> DataFrame:
    """g by each image's robust white point: upper edge of the histogram bin that reaches 99.5 % of the finite positives, unless that is 2 % of the maximum or less."""
    keys = ["image_id", "channel"]
    tops = pixels.where(FINITE(F.col("value")) & (F.col("value") > 0)).groupBy(*keys).agg(F.max("value").alias("_top"))
    placed = pixels.where(FINITE(F.col("value")) & (F.col("value") > 0)).join(tops, keys).withColumn("_bin", F.least(F.floor(F.col("value") * (F.lit(float(bins)) / F.col("_top"))), F.lit(bins - 1)))
    hist = placed.groupBy(*keys, "_top", "_bin").count()
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("count").over(Window.partitionBy(*keys))
    reached = hist.withColumn("_cum", F.sum("count").over(w)).withColumn("_target", F.ceil(total * 0.995)).where("_cum >= _target").groupBy(*keys, "_top").agg(F.min("_bin").alias("_bin"))
    edge = (F.col("_bin") + 1) * (F.col("_top") / F.lit(float(bins)))
    white = reached.select(*keys, F.when(edge > F.col("_top") * 0.02, edge).otherwise(F.col("_top")).alias("_white"))
    scale = F.when(F.col("_white") > 0, F.lit(255.0) / F.col("_white")).otherwise(F.lit(0.0))
    value = F.when(FINITE(F.col("value")), half_up(F.col("value") * scale)).otherwise(F.lit(0))
    return pixels.join(white, keys, "left").withColumn("g", F.coalesce(F.greatest(F.lit(0), F.least(F.lit(255), value)), F.lit(0)).cast("int")).drop("_white")


def to_gray_max(pixels: DataFrame) -> DataFrame:
    """level: value / max * 255 per image and channel, where the maximum is positive."""
    tops = pixels.groupBy("image_id", "channel").agg(F.max("value").alias("_top"))
    return pixels.join(tops, ["image_id", "channel"]).withColumn("level", F.when(F.col("_top") > 0, F.col("value") / F.col("_top") * 255.0).otherwise(F.col("value"))).drop("_top")


def threshold_mask(gray: DataFrame, threshold, level: str = "g") -> DataFrame:
    """Foreground: strictly above the threshold."""
    return gray.where(F.col(level) > threshold)


def mask_outside(gray: DataFrame, mask: DataFrame) -> DataFrame:
    """g is 0 outside the mask (image_id, x, y); inside says which pixels are in it."""
    m = mask.select("image_id", "x", "y").distinct().withColumn("inside", F.lit(True))
    out = gray.join(m, ["image_id", "x", "y"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    return out.withColumn("g", F.when(F.col("inside"), F.col("g")).otherwise(0))


#: Values of one image and channel that a window may order; beyond, values are counted in buckets first.
ORDERED, BUCKETS = 200_000, 2_048
QUANTILES = {"_p": 0.995, "threshold": 0.80}


def order_statistics(values: DataFrame, keys: list[str], quantiles: dict[str, float], ordered: int = ORDERED) -> DataFrame:
    """keys, n, lo, hi, and the nearest-rank quantiles of finite values (keys, value) by name. Exact.

    Groups of `ordered` values or fewer are ordered, each distinct value once. Larger ones are narrowed down in passes over the data, all groups and quantiles at once: values between the
    bounds of a quantile are counted in BUCKETS steps, and the bucket that holds its rank gives the next bounds. Steps are even; where that
    leaves a quarter of the values or more in one, the next steps are a geometric series, as values of many magnitudes need. So no task orders more than `ordered` values
    and BUCKETS counts of a group.
    """
    rank = lambda q: half_up(F.lit(q) * (F.col("n") - 1)).cast("long")
    sizes = written(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    big = sizes.where(F.col("n") > ordered)
    some_big = big.limit(1).count() > 0

    few = values.join(big.select(*keys), keys, "left_anti") if some_big else values
    w = Window.partitionBy(*keys)
    counts = few.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))
    ranked = counts.withColumn("n", F.sum("c").over(w)).withColumn("_last", F.sum("c").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    small = ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), *[F.min(F.when(F.col("_last") >= rank(q), F.col("value"))).alias(k) for k, q in quantiles.items()])
    if not some_big:
        return small

    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), rank(q).alias("rank")) for k, q in quantiles.items()]))
    bounds = big.withColumn("_q", wanted).select(*keys, F.col("_q.k").alias("_k"), F.col("_q.rank").alias("_rank"), F.col("n").alias("_n"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.lit(False).alias("_series"))
    rounds = Rounds(values.sparkSession)
    bounds = rounds.kept(bounds)
    each = [*keys, "_k"]
    still_open = (F.col("_n") > ordered) & (F.col("_lo") < F.col("_hi"))
    while bounds.where(still_open).limit(1).count():
        share = (F.col("value") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        series = F.when(share <= 0, 0).otherwise(1 + F.floor((1 + F.log2(share) / 1_100) * (BUCKETS - 1)))
        put = values.join(bounds.where(still_open), keys).where("value between _lo and _hi").withColumn("_b", F.when(F.col("_series"), series).otherwise(F.floor(share * BUCKETS)))
        found = put.groupBy(*each, "_rank", "_n", "_series", "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        before = F.sum("_c").over(Window.partitionBy(*each).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
        held = found.withColumn("_before", before).where("_rank >= _before and _rank < _before + _c")
        narrower = held.select(*each, (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_c").alias("_n"), "_lo", "_hi", (~F.col("_series") & (4 * F.col("_c") > F.col("_n"))).alias("_series"))
        bounds = rounds.kept(narrower.unionByName(bounds.where(~still_open)))
    bounds = cut(bounds)
    rounds.remove()
    near = values.join(bounds.where("_lo < _hi"), keys).where("value between _lo and _hi").groupBy(*each, "_rank", "value").agg(F.count(F.lit(1)).alias("_c"))
    last = F.sum("_c").over(Window.partitionBy(*each).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - 1
    picked = near.withColumn("_last", last).where("_last >= _rank").groupBy(*each).agg(F.min("value").alias("_v")).unionByName(bounds.where("_lo = _hi").select(*each, F.col("_lo").alias("_v")))
    large = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(k) for k in quantiles]).join(big, keys)
    return small.unionByName(large.select(*small.columns))


def channel_stats(pixels: DataFrame, ordered: int = ORDERED) -> DataFrame:
    """Per image and channel over finite values: lo, hi, n, norm_lo, norm_hi (99.5 %), threshold (80 %); percentiles are nearest-rank."""
    keys = ["image_id", "channel"]
    s = order_statistics(pixels.where(FINITE(F.col("value"))).select(*keys, "value"), keys, QUANTILES, ordered)
    norm_hi = F.when(F.col("_p") > F.col("lo"), F.col("_p")).when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1.0)
    return s.select(*keys, "lo", "hi", "n", F.col("lo").alias("norm_lo"), norm_hi.alias("norm_hi"), "threshold")


def fraction_above(pixels: DataFrame, threshold) -> DataFrame:
    return pixels.where(FINITE(F.col("value"))).groupBy("image_id", "channel").agg(F.avg(F.when(F.col("value") > threshold, 1.0).otherwise(0.0)).alias("fraction"))


def kernel(sigma: float) -> list[float]:
    radius = max(1, math.ceil(sigma * 3))
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [v / sum(k) for v in k]


def _line(along: str, across: str):
    """Window over one pixel row or column of a dense image."""
    return Window.partitionBy("image_id", across).orderBy(along)


def _blur_pass(gray: DataFrame, along: str, across: str, weights: list[float]) -> DataFrame:
    """Weighted sum of the neighbours along a line; beyond the ends the end pixel counts."""
    w, radius, g = _line(along, across), len(weights) // 2, F.col("g")
    line = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = gray.withColumn("_first", F.first("g").over(line)).withColumn("_last", F.last("g").over(line))
    near = lambda i: g if i == 0 else F.coalesce(F.lag("g", -i).over(w), F.col("_first")) if i < 0 else F.coalesce(F.lead("g", i).over(w), F.col("_last"))
    total = reduce(lambda acc, i: acc + near(i) * F.lit(weights[i + radius]), range(-radius, radius + 1), F.lit(0.0))
    return ends.withColumn("_sum", total).drop("_first", "_last", "g").withColumnRenamed("_sum", "g")


def gaussian_blur(gray: DataFrame, sigma: float) -> DataFrame:
    """Separable blur of dense grey images (image_id, x, y, g, width, height); edges are clamped, rounding happens once at the end. One shuffle a pass."""
    if sigma <= 0.05:
        return gray
    k = kernel(sigma)
    g = gray.withColumn("g", F.col("g").cast("double"))
    out = _blur_pass(_blur_pass(g, "x", "y", k), "y", "x", k)
    # a sum that should end on a half may miss it by its last bit
    return out.withColumn("g", half_up(F.round(F.col("g"), 9)).cast("int")).select("image_id", "x", "y", "g", "width", "height")


def dense(pixels: DataFrame, width: int, height: int, level: str = "g", fill=0) -> DataFrame:
    """Every pixel of width x height images; missing ones are filled."""
    # a grid is made of few ids, which would end in one task, and windows over it take far more memory than its rows take when they are shuffled
    images = dealt(pixels.select("image_id").distinct(), "image_id")
    grid = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), "y")
    have = pixels.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), level)
    return grid.join(have, ["image_id", "x", "y"], "left").withColumn(level, F.coalesce(level, F.lit(fill))).withColumn("width", F.lit(width)).withColumn("height", F.lit(height))


def distance_transform(mask: DataFrame) -> DataFrame:
    """City-block distance to the nearest background pixel. mask: image_id, x, y, inside on a dense grid; an image without background has null."""
    def sweep(df: DataFrame, line: str, along: str, source: Column, name: str) -> DataFrame:
        base = Window.partitionBy("image_id", line)
        up = F.max(F.when(source.isNotNull(), F.col(along) - source)).over(base.orderBy(along).rowsBetween(Window.unboundedPreceding, 0))
        down = F.min(F.when(source.isNotNull(), F.col(along) + source)).over(base.orderBy(F.col(along).desc()).rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn(name, F.least(F.col(along) - up, down - F.col(along)))

    columns = sweep(dealt(mask, "image_id", "x"), "x", "y", F.when(~F.col("inside"), F.lit(0)), "_d")
    return sweep(dealt(columns, "image_id", "y"), "y", "x", F.col("_d"), "distance").drop("_d")


def local_maxima(dist: DataFrame, box: int, least: float, value: str = "distance") -> DataFrame:
    """Pixels that are the largest of their (2 box + 1)^2 window and at least `least`; of a plateau the lowest (y, x) within reach of each other stays."""
    by_row = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-box, box)
    by_column = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-box, box)
    # rank ties by place, so that one pixel of a plateau wins its window
    key = F.struct(F.col(value).alias("v"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))
    rows = dealt(dist, "image_id", "y").withColumn("_r", F.max(key).over(by_row))
    top = dealt(rows, "image_id", "x").withColumn("_c", F.max("_r").over(by_column)).withColumn("_k", key)
    return top.where((F.col(value) >= least) & (F.col("_k") == F.col("_c"))).drop("_k", "_r", "_c")


def sobel(gray: DataFrame) -> DataFrame:
    """gx, gy of dense grey images for inner pixels: separable, one shuffle for columns and one for rows."""
    return _gradients(gray).where("gx is not null").select("image_id", "width", "height", "x", "y", "gx", "gy")


def _around(c: str, w) -> tuple[Column, Column, Column]:
    return F.lag(c).over(w), F.col(c), F.lead(c).over(w)


def _gradients(gray: DataFrame) -> DataFrame:
    """All pixels with gx and gy, null at the image's rim; rows lie in order within tasks."""
    above, here, below = _around("g", _line("y", "x"))
    first = gray.withColumn("_smooth", above + 2 * here + below).withColumn("_step", below - above)
    row = _line("x", "y")
    (s0, _, s2), (d0, d1, d2) = _around("_smooth", row), _around("_step", row)
    inner = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("width") - 1) & (F.col("y") < F.col("height") - 1)
    both = first.withColumn("_gx", s2 - s0).withColumn("_gy", d0 + 2 * d1 + d2)
    return both.select("image_id", "width", "height", "x", "y", F.when(inner, F.col("_gx")).alias("gx"), F.when(inner, F.col("_gy")).alias("gy"))


def thin_edges(gray: DataFrame, low: int = 40, high: int = 120) -> DataFrame:
    """image_id, x, y, magnitude, strong: gradient ridges (|gx| + |gy|), kept where no neighbour across the edge is larger and the magnitude exceeds `low`.

    Neighbours come from windows over rows, then columns: pixels move three times in all, and nothing is joined.
    """
    g = _gradients(gray).withColumn("m", F.abs("gx") + F.abs("gy"))
    left, _, right = _around("m", _line("x", "y"))
    rows = g.withColumn("_row", F.struct(left.alias("left"), F.col("m").alias("here"), right.alias("right")))
    column = _line("y", "x")
    put = rows.withColumn("_above", F.lag("_row").over(column)).withColumn("_below", F.lead("_row").over(column)).where(F.col("m") > low)
    ax, ay = F.abs("gx"), F.abs("gy")
    # the sector of the gradient: along x, along y, or one of the diagonals (tan 22.5 and tan 67.5 degrees)
    along_x, along_y, falling = ay * 1000 < ax * 414, ay * 1000 > ax * 2414, (F.col("gx") >= 0) == (F.col("gy") >= 0)
    pick = lambda x, y, down, up: F.when(along_x, F.col(x)).when(along_y, F.col(y)).when(falling, F.col(down)).otherwise(F.col(up))
    before, after = pick("_row.left", "_above.here", "_above.left", "_below.left"), pick("_row.right", "_below.here", "_below.right", "_above.right")
    # of two equal neighbours the one before stays
    kept = put.where(F.coalesce(before < F.col("m"), F.lit(True)) & F.coalesce(after <= F.col("m"), F.lit(True)))
    return kept.select("image_id", "x", "y", F.col("m").alias("magnitude"), (F.col("m") > high).alias("strong"))
