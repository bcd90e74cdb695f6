"""Compositions: post-processing of traced fibres, and the analysis of regions from pixels to objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberlake.functions import geometry as g
from fiberlake.operators import boundary, detect, fibers, pixels, seams, tiles
from fiberlake.operators.rounds import beside, unsent, written


def postprocess(traced: DataFrame, rings: DataFrame | None = None, dedup_tol: float = 4.0, stitch_tol: float = 6.0, angle_tol: float = 45.0, zone: float = 100.0, many_tiles: bool = True) -> DataFrame:
    """With more than one tile duplicates go and pieces are joined; ids become dense, classes are set where an outline is given."""
    out = seams.stitch_fibers(seams.dedup_fibers(traced, dedup_tol), stitch_tol, angle_tol) if many_tiles else traced
    out = fibers.renumber(out).drop("fiber_id").withColumnRenamed("new_id", "fiber_id")
    return boundary.classify_tacs(boundary.nearest_boundary(out, rings, zone)) if rings is not None else out


def analyse(raw: DataFrame, regions: DataFrame, rings: DataFrame | None = None, core: int = 768, overlap: int = 96, threshold=None, min_length: float = 15, max_width: float | None = 40, budget: int = 250_000, **limits) -> DataFrame:
    """Pixels of regions (origin 0, downsample 1) to post-processed fibres: statistics, grey, tiles, detection, ownership, seams.

    What is not above the threshold is background. A tile with more foreground than the budget is detected at the eased
    threshold that retry_dense finds for it; one that stays too dense is left out, and doesn't stop the others.
    """
    return analyse_with_report(raw, regions, rings, core, overlap, threshold, min_length, max_width, budget, **limits)[0]


def analyse_with_report(raw: DataFrame, regions: DataFrame, rings: DataFrame | None = None, core: int = 768, overlap: int = 96, threshold=None, min_length: float = 15, max_width: float | None = 40, budget: int = 250_000, **limits) -> tuple[DataFrame, DataFrame]:
    """(fibres of analyse, request_stats rows of all its tiles), of one detection."""
    stats = written(pixels.channel_stats(raw))
    gray = pixels.to_gray(raw.join(beside(stats.select("image_id", "channel", "norm_lo", "norm_hi", "threshold")), ["image_id", "channel"]), F.col("norm_lo"), F.col("norm_hi"))
    level = F.lit(threshold) if threshold is not None else F.greatest(F.lit(0), F.least(F.lit(255), g.half_up((F.col("threshold") - F.col("norm_lo")) / F.when(F.col("norm_hi") > F.col("norm_lo"), F.col("norm_hi") - F.col("norm_lo")).otherwise(1.0) * 255.0)))
    levels = stats.groupBy("image_id").agg(F.max(level.cast("double")).alias("_level"))
    cut_up = written(tiles.make_tiles(regions, core, overlap))
    keys = ["image_id", "tile_id"]
    dense = tiles.dense_tiles(gray, cut_up).join(beside(levels), "image_id")
    runs = written(detect.retry_dense(dense, keys, budget, F.col("_level")))
    local = dense.join(beside(runs.where("ok").select(*keys, "threshold")), keys).withColumn("g", F.when(F.col("g") > F.col("threshold"), F.col("g")).otherwise(0)).drop("threshold", "_level")
    traced = written(detect.detect(local, keys, **limits))
    report = fibers.request_stats(traced, runs, min_length, max_width)
    if "error" in traced.columns:
        traced = traced.where("error is null").drop("error")
    at = traced.join(unsent(cut_up.select(*keys, "read_x0", "read_y0")), keys)
    moved = at.withColumn("points", g.moved(F.col("points"), F.col("read_x0"), F.col("read_y0"))).withColumn("center", g.point(F.col("center.x") + F.col("read_x0"), F.col("center.y") + F.col("read_y0"))).drop("read_x0", "read_y0")
    # ids become unique within the image before tiles meet
    own = tiles.owned_by_core(fibers.filter_max_width(fibers.filter_min_length(moved, min_length), max_width), cut_up)
    own = fibers.renumber(own).drop("fiber_id").withColumn("fiber_id", F.col("new_id").cast("long")).drop("new_id")
    return postprocess(own, rings), report
