"""Fibres from grey pixels: seeds on the distance map's ridges, each with a direction, joined into paths.

A seed has two ends, one in each sense of its direction. An end takes the best end of another seed that lies ahead of it and
faces it; choices that are mutual are links, and ends that are left choose again. So no end has two links, links form
paths, and paths are ordered by pointer doubling. An approximation of a compiled tracer, for curved fibres with widths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiberlake.functions import geometry as g
from fiberlake.operators import pixels, ridge_blocks
from fiberlake.operators.fibers import measured
from fiberlake.operators.rounds import cut, written
from fiberlake.operators.seams import match_ends, near_pairs, ordered_chains, settled


def spaced_maxima(dist: DataFrame, box: int, least: float, value: str = "distance") -> DataFrame:
    """Pixels of dense images at `least` or more that no neighbour exceeds, thinned so that no two are within `box` of each other in both x and y.

    The larger stays, and of a plateau a scattered choice of pixels, in rounds: a long ridge of one height keeps a pixel every few steps, not its first one alone.
    """
    return spaced(cut(ridges(dist, least, value)), box, value)


def ridges(dist: DataFrame, least: float, value: str = "distance") -> DataFrame:
    """Pixels of dense images at `least` or more that no neighbour exceeds."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-1, 1), Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-1, 1)
    top = dist.withColumn("_r", F.max(value).over(row)).withColumn("_top", F.max("_r").over(column))
    return top.where((F.col(value) >= least) & (F.col(value) == F.col("_top"))).drop("_r", "_top")


def spaced(found: DataFrame, box: int, value: str = "distance") -> DataFrame:
    """found (image_id, x, y, value) thinned in rounds."""
    # a scattered order of places, so that rounds don't run along a plateau
    rank = F.struct(F.col(value).alias("v"), ((F.col("x") * 7_919 + F.col("y") * 104_729) % 65_537).alias("s"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    keyed = found.select("image_id", F.struct("y", "x").alias("p"), "x", "y", rank.alias("k"))
    a, b = (keyed.select("image_id", *[F.col(c).alias(f"{s}{c}") for c in ("p", "x", "y", "k")]) for s in "ab")
    pairs = near_pairs(a, b, "ax", "ay", "bx", "by", math.sqrt(2) * box, ["image_id"]).where(f"abs(ax - bx) <= {box} and abs(ay - by) <= {box} and ak > bk")
    gone = settled(pairs.select("image_id", F.col("ap").alias("better"), F.col("bp").alias("worse"))).select("image_id", F.col("worse.y").alias("y"), F.col("worse.x").alias("x"))
    return found.join(gone, ["image_id", "y", "x"], "left_anti").select(*found.columns)


def turned(seeds: DataFrame) -> DataFrame:
    """ux, uy for xx, yy, xy (sums of products of gradients): the direction along which grey values change least."""
    turn = F.atan2(2.0 * F.col("xy"), (F.col("xx") - F.col("yy")).cast("double")) / 2
    return seeds.withColumn("ux", -F.sin(turn)).withColumn("uy", F.cos(turn)).drop("xx", "yy", "xy")


def tensors(gray: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """Seeds inside the rim with xx, yy, xy over a window of 2 reach + 1 pixels (dense grey images)."""
    grad = pixels.sobel(gray)
    parts = {"xx": F.col("gx") * F.col("gx"), "yy": F.col("gy") * F.col("gy"), "xy": F.col("gx") * F.col("gy")}
    row = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-reach, reach)
    column = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-reach, reach)
    by_row = grad.select("image_id", "x", "y", *[F.sum(e).over(row).alias(k) for k, e in parts.items()])
    by_both = by_row.select("image_id", "x", "y", *[F.sum(k).over(column).alias(k) for k in parts])
    return seeds.join(by_both, ["image_id", "x", "y"])


def directed(gray: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """Seeds with ux, uy: the direction along which grey values change least around them (structure tensor of a window of 2 reach + 1 pixels; dense grey images)."""
    return turned(tensors(gray, seeds, reach))


def facing_ends(seeds: DataFrame, reach: float, bend: float) -> DataFrame:
    """Pairs of seeds (a before b) that lie ahead of each other: image_id, gap, a, a_end, b, b_end, ax, ay, bx, by. seeds: image_id, seed_id, x, y, ux, uy.

    End 1 is the one in the seed's direction, end 0 the other. Both directions turn from the straight line between the seeds by `bend` degrees at
    most; gap is its length, longer by the share that they turn.
    """
    side = lambda s: seeds.select("image_id", F.col("seed_id").alias(s), *[F.col(c).cast("double").alias(f"{s}{c}") for c in ("x", "y", "ux", "uy")])
    p = near_pairs(side("a"), side("b"), "ax", "ay", "bx", "by", reach, ["image_id"]).where("a < b and dist > 0")
    along = lambda s: g.rounded(((F.col("bx") - F.col("ax")) * F.col(f"{s}ux") + (F.col("by") - F.col("ay")) * F.col(f"{s}uy")) / F.col("dist"), 9)
    p = p.withColumn("_a", along("a")).withColumn("_b", along("b"))
    ahead = (F.abs("_a") >= math.cos(math.radians(bend))) & (F.abs("_b") >= math.cos(math.radians(bend)))
    gap = g.rounded(F.col("dist") * (3.0 - F.abs("_a") - F.abs("_b")), 6)
    return p.where(ahead).select("image_id", gap.alias("gap"), "a", F.when(F.col("_a") >= 0, 1).otherwise(0).alias("a_end"), "b", F.when(F.col("_b") >= 0, 0).otherwise(1).alias("b_end"), "ax", "ay", "bx", "by")


def first_choices(ends: DataFrame) -> DataFrame:
    """The pairs of which both ends are each other's best (smallest gap, then ids): what one round of choosing links."""
    order = ["gap", "a", "a_end", "b", "b_end"]
    sides = ends.select("*", F.explode(F.array(F.struct(F.col("a").alias("f"), F.col("a_end").alias("e")), F.struct(F.col("b").alias("f"), F.col("b_end").alias("e")))).alias("_s"))
    ranked = sides.withColumn("_r", F.row_number().over(Window.partitionBy("image_id", "_s.f", "_s.e").orderBy(*order)))
    return ranked.where("_r = 1").groupBy("image_id", *order).agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")


def over_foreground(ends: DataFrame, mask: DataFrame, steps: int = 4) -> DataFrame:
    """The pairs whose line, at `steps` - 1 places between the seeds, is foreground. mask: image_id, y, x, to: runs of foreground pixels that don't meet."""
    order = ["image_id", "gap", "a", "a_end", "b", "b_end"]
    at = lambda c: g.half_up(F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * F.col("_i") / F.lit(steps)).cast("int").alias(f"_{c}")
    places = ends.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(steps - 1)))).select(*order, at("x"), at("y"))
    met = places.join(mask.select("image_id", F.col("y").alias("_y"), "x", "to"), ["image_id", "_y"]).where("_x between x and to")
    return met.groupBy(*order).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == steps - 1).drop("_n")


def trace(gray: DataFrame, threshold: Column, spacing: int = 4, least: float = 2, reach: float = 13.0, bend: float = 40.0, window: int = 3, shortest: int = 3, sigma: float = 0.0, side: int = ridge_blocks.SIDE) -> DataFrame:
    """Fibres of dense grey images: image_id, fiber_id, points, width, and what is measured from the points.

    gray: image_id, x, y, g, width, height; blurred by sigma first, of which the threshold takes no part. Foreground is above the threshold; seeds are ridge pixels of its distance map at `least` or more,
    `spacing` apart; seeds within `reach` whose directions bend by `bend` degrees at most may be joined. Fibres of fewer than `shortest` seeds go.
    Points are pixels; the width is twice the mean distance to the background, less one, as rows of odd thickness have it.
    Images are read in blocks of `side` x `side`; those with distances that reach further than a block sees go by windows over their pixel rows.
    """
    gray = gray.select("image_id", "x", "y", "g", "width", "height", threshold.cast("double").alias("_limit"))
    said = written(ridge_blocks.said(gray, sigma, least, spacing, window, side))
    doubted = said.where(F.col("kind") == ridge_blocks.DOUBT).select("image_id").distinct()
    if doubted.limit(1).count():
        by_rows = written(_said_by_rows(gray.join(doubted, "image_id", "left_semi"), sigma, least, window))
        said = said.join(doubted, "image_id", "left_anti").unionByName(by_rows)
    found = said.where(F.col("kind") == ridge_blocks.RIDGE).drop("kind", "to")
    found = found.where("not open").unionByName(spaced(cut(found.where("open")), spacing))
    id_of = F.col("y").cast("long") * F.lit(1 << 32) + F.col("x")
    seeds = cut(turned(found.where("not rim")).withColumn("seed_id", id_of).select("image_id", "seed_id", "x", "y", "distance", "ux", "uy"))
    ends = over_foreground(facing_ends(seeds, reach, bend), said.where(F.col("kind") == ridge_blocks.RUN))
    links = match_ends(ends.withColumn("same_tile", F.lit(False)))
    placed = ordered_chains(cut(links)).withColumnRenamed("fiber_id", "seed_id").join(seeds, ["image_id", "seed_id"])
    paths = placed.groupBy("image_id", F.col("chain").alias("fiber_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x", "y"))), lambda p: g.point(p["x"], p["y"])).alias("points"), (2 * F.avg("distance") - 1).alias("width"))
    return measured(paths.where(F.size("points") >= shortest))


def _said_by_rows(gray: DataFrame, sigma: float, least: float, window: int) -> DataFrame:
    """What ridge_blocks.said says, by windows over pixel rows, at any distance; all ridge pixels are open."""
    limits = gray.select("image_id", "x", "y", "_limit")
    gray = cut(pixels.gaussian_blur(gray.drop("_limit"), sigma))
    mask = cut(gray.join(limits, ["image_id", "x", "y"]).select("image_id", "x", "y", (F.col("g") > F.col("_limit")).alias("inside")))
    found = cut(ridges(pixels.distance_transform(mask), least).select("image_id", "x", "y", "distance"))
    put = found.join(tensors(gray, found.select("image_id", "x", "y"), window), ["image_id", "x", "y"], "left")
    none = F.lit(None)
    tops = put.select("image_id", F.lit(ridge_blocks.RIDGE).alias("kind"), "x", "y", none.cast("int").alias("to"), "distance", F.lit(True).alias("open"), F.col("xx").isNull().alias("rim"), *[F.col(c).cast("double").alias(c) for c in ("xx", "yy", "xy")])
    runs = mask.where("inside").select("image_id", F.lit(ridge_blocks.RUN).alias("kind"), "x", "y", F.col("x").alias("to"), *[none.cast(t).alias(c) for c, t in (("distance", "int"), ("open", "boolean"), ("rim", "boolean"), ("xx", "double"), ("yy", "double"), ("xy", "double"))])
    return tops.unionByName(runs)
