"""Overlapping tiles of regions, and who owns what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiberlake.functions.geometry import half_up
from fiberlake.operators.rounds import beside, unsent, written


def make_tiles(regions: DataFrame, core: int = 768, overlap: int = 96, max_tiles: int | None = 64) -> DataFrame:
    """Tiles of each region (image_id, x, y, width, height, downsample), row by row: core box, read box (core and overlap, clamped), both in analysed pixels, and the read box in full pixels.

    Optional columns image_width and image_height clamp the full box; tiles that lie outside the image are left out.
    """
    edge = [(F.col(c) if c in regions.columns else F.lit(None)).cast("int").alias(c) for c in ("image_width", "image_height")]
    r = regions.select("image_id", "x", "y", "downsample", *edge, F.ceil(F.col("width") / F.col("downsample")).cast("int").alias("w"), F.ceil(F.col("height") / F.col("downsample")).cast("int").alias("h"))
    grid = F.struct(F.greatest(F.lit(1), F.ceil(F.col("w") / core)).cast("int").alias("c"), F.greatest(F.lit(1), F.ceil(F.col("h") / core)).cast("int").alias("r"))
    r = r.withColumn("_g", grid)
    if max_tiles is not None:
        over = lambda s: s["c"] * s["r"] > max_tiles
        shrink = lambda s, _: F.when(~over(s), s).when((s["c"] >= s["r"]) & (s["c"] > 1), F.struct((s["c"] - 1).alias("c"), s["r"].alias("r"))).when(s["r"] > 1, F.struct(s["c"].alias("c"), (s["r"] - 1).alias("r"))).otherwise(s)
        r = r.withColumn("_g", F.aggregate(F.sequence(F.lit(0), F.col("_g.c") + F.col("_g.r")), F.col("_g"), shrink))
    r = r.select("*", F.ceil(F.col("w") / F.col("_g.c")).cast("int").alias("cw"), F.ceil(F.col("h") / F.col("_g.r")).cast("int").alias("ch"))
    t = r.select("*", F.explode(F.sequence(F.lit(0), F.col("_g.r") - 1)).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.col("_g.c") - 1)).alias("col"))
    t = t.withColumn("core_x0", F.col("col") * F.col("cw")).withColumn("core_x1", F.least("w", (F.col("col") + 1) * F.col("cw"))).withColumn("core_y0", F.col("row") * F.col("ch")).withColumn("core_y1", F.least("h", (F.col("row") + 1) * F.col("ch")))
    t = t.where("core_x0 < core_x1 and core_y0 < core_y1")
    read = {"read_x0": F.greatest(F.lit(0), F.col("core_x0") - overlap), "read_x1": F.least("w", F.col("core_x1") + overlap), "read_y0": F.greatest(F.lit(0), F.col("core_y0") - overlap), "read_y1": F.least("h", F.col("core_y1") + overlap)}
    t = t.withColumns(read)
    full = {"full_x": F.col("x") + half_up(F.col("read_x0") * F.col("downsample")), "full_y": F.col("y") + half_up(F.col("read_y0") * F.col("downsample"))}
    size = lambda a, b, edge, at: F.least(F.col(edge) - F.col(at), half_up((F.col(b) - F.col(a)) * F.col("downsample"))).cast("long")
    t = t.withColumns(full).withColumns({"full_w": size("read_x0", "read_x1", "image_width", "full_x"), "full_h": size("read_y0", "read_y1", "image_height", "full_y")}).where("full_w > 0 and full_h > 0")
    t = t.withColumn("tile_id", F.row_number().over(Window.partitionBy("image_id").orderBy("row", "col")) - 1)
    return t.select("image_id", "tile_id", "core_x0", "core_x1", "core_y0", "core_y1", "read_x0", "read_x1", "read_y0", "read_y1", "full_x", "full_y", "full_w", "full_h")


def assign_tiles(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each pixel once for every tile that reads it.

    Tiles are keyed by the cells of a grid as fine as the cores, so this is an equi-join and not a range join.
    """
    return _assigned(pixels, written(tiles)).select(*pixels.columns, "tile_id")


def _assigned(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """assign_tiles with the read boxes of the tiles, which have been written."""
    steps = tiles.groupBy("image_id").agg(F.max(F.col("core_x1") - F.col("core_x0")).alias("_cw"), F.max(F.col("core_y1") - F.col("core_y0")).alias("_ch"))
    t = tiles.join(steps, "image_id")
    span = lambda lo, hi, c: F.sequence(F.floor(F.col(lo) / F.col(c)), F.floor((F.col(hi) - 1) / F.col(c)))
    t = t.withColumn("_gx", F.explode(span("read_x0", "read_x1", "_cw"))).withColumn("_gy", F.explode(span("read_y0", "read_y1", "_ch")))
    p = pixels.join(beside(steps), "image_id").withColumn("_gx", F.floor(F.col("x") / F.col("_cw"))).withColumn("_gy", F.floor(F.col("y") / F.col("_ch")))
    met = p.drop("_cw", "_ch").join(beside(t.select("image_id", "_gx", "_gy", "tile_id", "read_x0", "read_x1", "read_y0", "read_y1")), ["image_id", "_gx", "_gy"])
    return met.where("x >= read_x0 and x < read_x1 and y >= read_y0 and y < read_y1").drop("_gx", "_gy")


def dense_tiles(gray: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every pixel of each tile's read box in the tile's own frame (image_id, tile_id, x, y, g, width, height); missing pixels are background. gray: one row a pixel.

    Pixels go to the tiles that read them by a join with the tiles; only tiles that lack pixels get a grid, from which those they have are taken away.
    """
    tiles = written(tiles)
    sides = [(F.col("read_x1") - F.col("read_x0")).alias("width"), (F.col("read_y1") - F.col("read_y0")).alias("height")]
    box = tiles.select("image_id", "tile_id", *sides)
    keys = ["image_id", "tile_id"]
    have = _assigned(gray.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.coalesce("g", F.lit(0)).alias("g")), tiles)
    lacking = written(box.join(unsent(have.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))), keys, "left").where(F.coalesce("_n", F.lit(0)) < F.col("width").cast("long") * F.col("height")).drop("_n"))
    own = have.select(*keys, (F.col("x") - F.col("read_x0")).alias("x"), (F.col("y") - F.col("read_y0")).alias("y"), "g", *sides)
    if not lacking.limit(1).count():
        return own
    grid = lacking.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    there = own.join(beside(lacking.select(*keys)), keys, "left_semi").select(*keys, "x", "y")
    return own.unionByName(grid.join(unsent(there), [*keys, "x", "y"], "left_anti").select(*keys, "x", "y", F.lit(0).cast(dict(own.dtypes)["g"]).alias("g"), "width", "height"))


def pick_tile(tiles: DataFrame, points: DataFrame) -> DataFrame:
    """The tile whose core holds each point (image_id, px, py), else the middle one; 0 where an image has no tile at all."""
    counts = tiles.groupBy("image_id").agg(F.floor(F.count(F.lit(1)) / 2).cast("int").alias("_middle"))
    inside = tiles.select("image_id", "tile_id", "core_x0", "core_x1", "core_y0", "core_y1")
    met = points.join(inside, "image_id").where("px >= core_x0 and px < core_x1 and py >= core_y0 and py < core_y1")
    hit = met.groupBy("image_id", "px", "py").agg(F.min("tile_id").alias("tile_id"))
    return points.join(hit, ["image_id", "px", "py"], "left").join(counts, "image_id", "left").select(*points.columns, F.coalesce("tile_id", "_middle", F.lit(0)).alias("tile_id"))


def owned_by_core(fibers: DataFrame, tiles: DataFrame) -> DataFrame:
    """Fibres whose centre lies in the half-open core of their own tile; images of one tile keep all."""
    n = tiles.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    t = tiles.select("image_id", "tile_id", "core_x0", "core_x1", "core_y0", "core_y1").join(n, "image_id")
    met = fibers.join(unsent(t), ["image_id", "tile_id"])
    own = (F.col("center.x") >= F.col("core_x0")) & (F.col("center.x") < F.col("core_x1")) & (F.col("center.y") >= F.col("core_y0")) & (F.col("center.y") < F.col("core_y1"))
    return met.where((F.col("_n") == 1) | own).select(*fibers.columns)


def tile_name(tiles: DataFrame, downsample, channel) -> DataFrame:
    """File name of an exported tile: origin in full pixels, size, downsample (2, or 1p5), channel."""
    d = F.when(F.col("_d") == F.floor("_d"), F.floor("_d").cast("string")).otherwise(F.regexp_replace(F.col("_d").cast("string"), r"\.", "p"))
    t = tiles.withColumn("_d", downsample)
    name = F.concat(F.lit("fiberlake_tile_x"), "full_x", F.lit("_y"), "full_y", F.lit("_w"), F.col("read_x1") - F.col("read_x0"), F.lit("_h"), F.col("read_y1") - F.col("read_y0"), F.lit("_ds"), d, F.lit("_ch"), channel, F.lit(".parquet"))
    return t.withColumn("file_name", name).drop("_d")


def export_tile(gray: DataFrame, tiles: DataFrame, tile_id: int, path: str, downsample=None, channel: int = 0) -> DataFrame:
    """Writes the grey pixels that a tracer sees for one tile of every image, each tile in a folder that bears its name (file_name=...); returns image_id, tile_id, file_name."""
    names = tile_name(tiles.where(F.col("tile_id") == tile_id), F.lit(1.0) if downsample is None else downsample, F.lit(str(channel))).select("image_id", "tile_id", "file_name")
    seen = assign_tiles(gray, tiles).where(F.col("tile_id") == tile_id)
    seen.join(names, ["image_id", "tile_id"]).write.mode("overwrite").partitionBy("file_name").parquet(path)
    return names
