"""Fibre operators: reconstruction, measuring, filters, reports and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiberlake.functions import geometry as g
from fiberlake.functions.params import calibrated

CLASSES = ("TACS-1", "TACS-2", "TACS-3")


def reconstruct_polylines(paths: DataFrame, vertices: DataFrame) -> DataFrame:
    """Fibres from ordered vertex ids. paths: keys image_id, tile_id, fiber_id, v (ids of the line), fa_v (ids of its width); vertices: image_id, vertex_id, x, y, radius.

    Unknown ids are skipped; lines of fewer than two known vertices go. Width is twice the mean radius over fa_v.
    """
    keys = ["image_id", "tile_id", "fiber_id"]
    at = paths.select(*keys, F.posexplode("v").alias("pos", "vertex_id")).join(vertices.select("image_id", "vertex_id", "x", "y"), ["image_id", "vertex_id"])
    line = at.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))), lambda p: g.point(p["x"], p["y"])).alias("points")).where(F.size("points") >= 2)
    wide = paths.select(*keys, F.explode("fa_v").alias("vertex_id")).join(vertices.select("image_id", "vertex_id", "radius"), ["image_id", "vertex_id"]).groupBy(*keys).agg((2 * F.avg("radius")).alias("width"))
    return measured(line.join(wide, keys, "left"))


def measured(fibers: DataFrame) -> DataFrame:
    """center (middle vertex), length_arc, length_end, angle, straightness from points."""
    p = F.col("points")
    f = fibers.withColumn("center", g.middle_vertex(p)).withColumn("length_arc", g.arc_length(p)).withColumn("length_end", g.end_length(p)).withColumn("angle", g.end_angle(p))
    return f.withColumn("straightness", g.straightness(F.col("length_arc"), F.col("length_end")))


def valid_geometry(fibers: DataFrame) -> DataFrame:
    """Fibres with a centre and at least two usable points; unusable points go."""
    usable = F.filter("points", lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())
    return fibers.withColumn("points", usable).where((F.size("points") >= 2) & F.col("center").isNotNull())


def filter_min_length(fibers: DataFrame, least: float) -> DataFrame:
    """Strictly longer; 0 is off."""
    return fibers.where(F.col("length_arc") > least) if least > 0 else fibers


def filter_max_width(fibers: DataFrame, most: float | None) -> DataFrame:
    """Unknown widths stay; 0 or None is off."""
    return fibers.where(F.col("width").isNull() | F.isnan("width") | (F.col("width") <= most)) if most else fibers


def filter_counts(fibers: DataFrame, least: float, most: float | None) -> DataFrame:
    """Per image and tile: traced, after length, dropped by length, dropped by width."""
    long = (F.col("length_arc") > least) if least > 0 else F.lit(True)
    wide = F.coalesce(F.col("width") > most, F.lit(False)) if most else F.lit(False)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return fibers.groupBy("image_id", "tile_id").agg(F.count(F.lit(1)).alias("n_traced"), count(long).alias("n_after_length"), count(~long).alias("n_length_dropped"), count(long & wide).alias("n_width_dropped"))


def request_stats(traced: DataFrame, tile_runs: DataFrame, least: float, most: float | None) -> DataFrame:
    """A row for each tile that was asked for, also one without fibres: image_id, tile_id, ok, n_traced, n_after_length, n_length_dropped, min_length_px, n_width_dropped, seed_spacing_used, seed_auto_raised, frac_above.

    traced: fibres before any filter[, error: why a tracer gave up on a tile]; tile_runs: image_id, tile_id, ok, spacing, raised, foreground, pixels.
    A tile is not ok if it stayed too dense or its tracer failed. frac_above is the share of pixels above the threshold that was used.
    """
    keys, failed = ["image_id", "tile_id"], None
    if "error" in traced.columns:
        failed = traced.where("error is not null").select(*keys).distinct().withColumn("_failed", F.lit(True))
        traced = traced.where("error is null")
    out = tile_runs.join(filter_counts(traced, least, most), keys, "left")
    out = out.join(failed, keys, "left") if failed is not None else out.withColumn("_failed", F.lit(None).cast("boolean"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        *keys, (F.col("ok") & F.col("_failed").isNull()).alias("ok"), zero("n_traced"), zero("n_after_length"), zero("n_length_dropped"), F.lit(float(least)).alias("min_length_px"), zero("n_width_dropped"),
        F.col("spacing").alias("seed_spacing_used"), F.col("raised").alias("seed_auto_raised"), F.bround(F.col("foreground") / F.col("pixels"), 4).alias("frac_above"),
    )


def in_bounds(fibers: DataFrame, width, height) -> DataFrame:
    return fibers.where((F.col("center.x") >= 0) & (F.col("center.x") < width) & (F.col("center.y") >= 0) & (F.col("center.y") < height))


def filter_vertices(fibers: DataFrame, least: int = 3) -> DataFrame:
    return fibers.where(F.size("points") >= least)


def exclude_edge(fibers: DataFrame, width, height, margin: float = 10) -> DataFrame:
    """Fibres whose points all lie within the margin of one image edge go."""
    hugs = [F.forall("points", lambda p: p["x"] < margin), F.forall("points", lambda p: p["x"] >= width - margin), F.forall("points", lambda p: p["y"] < margin), F.forall("points", lambda p: p["y"] >= height - margin)]
    return fibers.where(~(hugs[0] | hugs[1] | hugs[2] | hugs[3]))


def renumber(fibers: DataFrame) -> DataFrame:
    """Dense ids from 0 per image, by tile and former id."""
    return fibers.withColumn("new_id", F.row_number().over(Window.partitionBy("image_id").orderBy("tile_id", "fiber_id")) - 1)


def tile_orientation(fibers: DataFrame) -> DataFrame:
    """Per tile: fibres, mean and population deviation of the angle; degenerate below 5 degrees with more than three fibres."""
    a = fibers.groupBy("image_id", "tile_id").agg(F.count(F.lit(1)).alias("n"), F.avg("angle").alias("angle_mean"), F.stddev_pop("angle").alias("angle_std"))
    return a.withColumn("degenerate", (F.col("angle_std") < 5.0) & (F.col("n") > 3))


def run_diagnostics(tile_stats: DataFrame) -> DataFrame:
    """Per image: tiles, failed tiles, sums of the counters, the last tile's minimum length, and advice. tile_stats: image_id, tile_id, ok, n_traced, n_length_dropped, n_width_dropped[, seed_auto_raised, min_length_px]."""
    given = lambda c, otherwise: F.col(c) if c in tile_stats.columns else otherwise
    raised, shortest = given("seed_auto_raised", F.lit(False)), given("min_length_px", F.lit(None).cast("double"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    ok = lambda c: F.sum(F.when(F.col("ok"), F.col(c)).otherwise(0))
    a = tile_stats.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("tiles"), count(~F.col("ok")).alias("failed_tiles"), count(F.col("ok") & raised).alias("raised_tiles"),
        F.max_by(F.when(F.col("ok"), shortest), F.when(F.col("ok") & shortest.isNotNull(), F.col("tile_id"))).alias("min_length_px"), ok("n_traced").alias("n_traced"), ok("n_length_dropped").alias("n_length_dropped"), ok("n_width_dropped").alias("n_width_dropped"),
    )
    advice = F.concat_ws(
        " ",
        F.when((F.col("n_length_dropped") > 0) & (F.col("n_traced") > 0), F.concat(F.lit("traced "), "n_traced", F.lit(", "), "n_length_dropped", F.lit(" too short"), F.when(F.col("min_length_px").isNotNull(), F.format_string(" (%.0f px or less)", "min_length_px")).otherwise(F.lit("")), F.when(F.col("n_length_dropped") >= F.col("n_traced") * 0.5, F.lit(": lower the minimum length")).otherwise(F.lit("")), F.lit("."))),
        F.when(F.col("n_width_dropped") > 0, F.concat(F.col("n_width_dropped"), F.lit(" too wide."))),
        F.when(F.col("raised_tiles") > 0, F.concat(F.col("raised_tiles"), F.lit(" dense tiles coarsened."))),
        F.when(F.col("failed_tiles") > 0, F.concat(F.col("failed_tiles"), F.lit(" tiles failed: raise threshold, spacing or downsample."))),
    )
    return a.withColumn("advice", advice)


def tacs_counts(fibers: DataFrame) -> DataFrame:
    """Fibres per image and class, with totals (null image: all images; tacs 'all': all classes)."""
    named = fibers.select("image_id", F.coalesce("tacs", F.lit("none")).alias("tacs"))
    return named.rollup("image_id", "tacs").agg(F.count(F.lit(1)).alias("n")).select("image_id", F.coalesce("tacs", F.lit("all")).alias("tacs"), "n")


def to_objects(fibers: DataFrame, regions: DataFrame, fiber_class: str = "Fiber") -> DataFrame:
    """Objects in full-resolution pixels: class, name, colour, geometry and measurements (in um where calibrated). regions: image_id, x, y, downsample, pixel_size_um."""
    f = valid_geometry(fibers).join(regions.select("image_id", F.col("x").alias("_ox"), F.col("y").alias("_oy"), F.col("downsample").alias("_d"), F.col("pixel_size_um").alias("_um")), "image_id")
    classed = F.col("tacs").isNotNull() & (F.trim("tacs") != "")
    known = calibrated(F.col("_um"))
    to_unit = F.col("_d") * F.when(known, F.col("_um")).otherwise(F.lit(1.0))
    unit = F.when(known, F.lit("um")).otherwise(F.lit("px"))
    in_unit = lambda name: F.concat(F.lit(f"{name} ("), unit, F.lit(")"))
    entries = [
        (F.lit("Fiber ID"), F.col("fiber_id").cast("double")), (F.lit("Angle (deg)"), F.col("angle")), (in_unit("Length"), F.col("length_arc") * to_unit), (in_unit("End-to-end length"), F.col("length_end") * to_unit),
        (in_unit("Width"), F.col("width") * to_unit), (F.lit("Straightness"), F.col("straightness")), (F.lit("Angle to boundary tangent (deg)"), F.col("angle_to_tangent")), (in_unit("Distance to boundary"), F.col("distance_to_boundary") * to_unit),
    ]
    pairs = F.filter(F.array(*[F.struct(k.alias("key"), v.alias("value")) for k, v in entries]), lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]))
    return f.select(
        "image_id", "fiber_id", F.when(classed, F.col("tacs")).otherwise(F.lit(fiber_class)).alias("class"), F.concat(F.when(classed, F.concat(F.col("tacs"), F.lit(" "))).otherwise(F.lit("Fiber ")), F.col("fiber_id").cast("string")).alias("name"),
        F.when(classed, g.tacs_rgb(F.col("tacs"))).alias("rgb"), g.to_full(F.col("points"), F.col("_ox"), F.col("_oy"), F.col("_d")).alias("points"), F.map_from_entries(pairs).alias("measurements"),
    )


def replace_existing(store: DataFrame, new: DataFrame, regions: DataFrame, fiber_class: str = "Fiber") -> DataFrame:
    """The store without its fibre objects whose centroid is in the image's region (half-open), and the new objects. Both hold image_id, class, cx, cy."""
    r = regions.select(F.col("image_id").alias("_i"), F.col("x").alias("_x"), F.col("y").alias("_y"), "width", "height")
    gone = (F.col("image_id") == F.col("_i")) & F.col("class").isin(fiber_class, *CLASSES) & (F.col("cx") >= F.col("_x")) & (F.col("cx") < F.col("_x") + F.col("width")) & (F.col("cy") >= F.col("_y")) & (F.col("cy") < F.col("_y") + F.col("height"))
    return store.join(r, gone, "left_anti").unionByName(new)


def save_objects(objects: DataFrame, path: str) -> None:
    """Parquet, one folder per image; only the images at hand are replaced (the measurements map stays a column)."""
    objects.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image_id").parquet(path)


def save_geojson(objects: DataFrame, path: str) -> None:
    """GeoJSON features, one a line."""
    line = F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    props = F.struct(F.struct(F.col("class").alias("name"), "rgb").alias("classification"), "name", "measurements")
    objects.select("image_id", F.lit("Feature").alias("type"), F.col("fiber_id").alias("id"), line.alias("geometry"), props.alias("properties")).write.mode("overwrite").json(path)


def tsv_text(c: Column) -> Column:
    """Without tabs and line breaks; null is empty."""
    return F.coalesce(F.regexp_replace(c, r"[\t\n\r]", " "), F.lit(""))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded half up."""
    return F.format_string(f"%.{digits}f", g.rounded(x, digits))


def alternates(ranked: DataFrame, n: int = 2) -> DataFrame:
    """Per area: the sets ranked 2..n+1 as one text, '-' if none. ranked: area_id, rank, seed, sens, bend, link, score."""
    one = F.concat(F.lit("seed"), F.col("seed").cast("long").cast("string"), F.lit("/sens"), fixed(F.col("sens"), 2), F.lit("/bend"), fixed(F.col("bend"), 0), F.lit("/link"), fixed(F.col("link"), 0), F.lit(":"), fixed(F.col("score"), 2))
    texts = F.sort_array(F.collect_list(F.when(F.col("rank").between(2, n + 1), F.struct("rank", one.alias("t")))))
    joined = F.array_join(F.transform(texts, lambda s: s["t"]), " ")
    return ranked.groupBy("area_id").agg(F.when(joined == "", F.lit("-")).otherwise(joined).alias("alternates"))


def tuning_rows(best: DataFrame, ranked: DataFrame) -> DataFrame:
    """The text columns of a tuning report, one row for each area (the time stamp is added when it is written).

    best: area_id, image, annotation, n_pieces, region_w, region_h, in_roi_px, n_gt, seed, sens, bend, link, n_detected, count_ratio, in_band, len_factor, orient_err, score.
    """
    b = best.join(alternates(ranked), "area_id", "left")
    plain = [F.col(c).cast("long").cast("string").alias(c) for c in ("n_pieces", "region_w", "region_h", "in_roi_px", "n_gt", "seed")]
    return b.select(
        "area_id", tsv_text(F.col("image")).alias("image"), tsv_text(F.col("annotation")).alias("annotation"), *plain, fixed(F.col("sens"), 2).alias("seed_sens"), fixed(F.col("bend"), 0).alias("bend_deg"), fixed(F.col("link"), 0).alias("link_deg"),
        F.col("n_detected").cast("long").cast("string").alias("n_detected"), fixed(F.col("count_ratio"), 2).alias("count_ratio"), F.when(F.col("in_band"), "Y").otherwise("N").alias("in_band"), fixed(F.col("len_factor"), 2).alias("len_factor"),
        fixed(F.col("orient_err"), 1).alias("orient_err"), fixed(F.col("score"), 3).alias("score"), F.coalesce("alternates", F.lit("-")).alias("alternates"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def append_measurements(rows: DataFrame, path: str) -> None:
    """Appends tab-separated lines, stamped with the time, to a report: a folder of text files, with one header line among them however often it is appended to. Nulls are empty."""
    spark = rows.sparkSession
    stamped = rows.drop("area_id").select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "*")
    if not _exists(spark, path):
        spark.createDataFrame([("\t".join(stamped.columns),)], "value string").coalesce(1).write.mode("append").text(path)
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\n\r]", " "), F.lit("")) for c in stamped.columns]
    stamped.select(F.concat_ws("\t", *cells).alias("value")).write.mode("append").text(path)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a report, all columns as strings, named by its header."""
    lines = spark.read.text(path)
    names = lines.where(F.col("value").startswith("timestamp\t")).first()[0].split("\t")
    cells = F.split("value", "\t", -1)
    return lines.where(~F.col("value").startswith("timestamp\t")).select(*[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(names)])

