"""Outlines: parts, rasters, nearest boundary and classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiberlake.functions import geometry as g
from fiberlake.operators.pixels import FINITE
from fiberlake.operators.rounds import cut, dealt, unsent


def split_parts(rings: DataFrame) -> DataFrame:
    """Parts with area, with their area; an annotation without any keeps all of its parts as they are."""
    a = rings.withColumn("area", g.shoelace(F.col("vertices")))
    some = F.max("area").over(Window.partitionBy("image_id", "annotation_id")) > 0
    return a.withColumn("_some", some).where((F.col("area") > 0) | ~F.col("_some")).drop("_some")


def segments(rings: DataFrame) -> DataFrame:
    """Closed outlines as segments: image_id, annotation_id, part_id, seg, ax, ay, bx, by, tangent."""
    n = F.size("vertices")
    s = rings.select("image_id", "annotation_id", "part_id", F.posexplode("vertices").alias("seg", "a"), F.col("vertices"))
    b = F.get(F.col("vertices"), ((F.col("seg") + 1) % n).cast("int"))
    s = s.select("image_id", "annotation_id", "part_id", "seg", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    return s.where("ax <> bx or ay <> by").withColumn("tangent", g.axis_angle(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))


def point_to_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / square))).otherwise(F.lit(0.0))
    return g.distance(x, y, ax + t * dx, ay + t * dy)


def crossed_cells(segs: DataFrame, size: float, grown: bool = False) -> DataFrame:
    """segs (ax, ay, bx, by) once for each grid cell _gx, _gy of this size that a segment crosses, or, grown, that has a point within `size` of it.

    The segment is cut at the borders of each column of cells (widened if grown): the rows that this piece reaches are its cells there, so cells grow
    with a segment's length and not with its box.
    """
    cell = lambda c: F.floor(c / F.lit(float(size)))
    rim, wide = (1, size) if grown else (0, 0.0)
    s = segs.withColumn("_gx", F.explode(F.sequence(cell(F.least("ax", "bx")) - rim, cell(F.greatest("ax", "bx")) + rim)))
    dx = F.col("bx") - F.col("ax")
    # a touch further on both sides than the column, lest rounding parts a piece from its end
    border = lambda to, by: (to * F.lit(float(size)) + by - F.col("ax")) / dx
    t0, t1 = border(F.col("_gx"), -wide - 1e-6), border(F.col("_gx") + 1, wide + 1e-6)
    inside = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    y = lambda t, end: F.when(dx == 0, F.col(end)).otherwise(F.col("ay") + inside(t) * (F.col("by") - F.col("ay")))
    s = s.withColumn("_y0", y(t0, "ay")).withColumn("_y1", y(t1, "by"))
    rows = F.sequence(cell(F.least("_y0", "_y1") - 1e-6) - rim, cell(F.greatest("_y0", "_y1") + 1e-6) + rim)
    return s.withColumn("_gy", F.explode(rows)).drop("_y0", "_y1")


FIBER = ("image_id", "tile_id", "fiber_id")


def _nearest(met: DataFrame) -> DataFrame:
    """Of pairs of fibres and segments with distance _d the nearest of each fibre, the first of equal ones."""
    best = met.groupBy(*FIBER).agg(F.min(F.struct(F.col("_d").alias("d"), "annotation_id", "part_id", "seg", g.acute_difference(F.col("_angle"), F.col("tangent")).alias("a"))).alias("_b"))
    return best.select(*FIBER, F.col("_b.d").alias("distance_to_boundary"), F.col("_b.a").alias("angle_to_tangent"))


def nearest_boundary(fibers: DataFrame, rings: DataFrame, zone: float = 100.0, beyond: bool = False) -> DataFrame:
    """distance_to_boundary and angle_to_tangent of each fibre's centre within the zone (null beyond, unless asked for): its nearest outline segment, the first of equal ones.

    A segment is sent to the grid cells (as wide as the zone) that have a point within the zone of it. With beyond=True, fibres further away
    search for theirs from coarse cells to fine ones; only fibres of images without any outline, or without a finite centre, have none then.
    """
    cell = lambda c: F.floor(c / F.lit(float(zone)))
    s = segments(rings)
    f = fibers.select(*FIBER, F.col("angle").alias("_angle"), F.col("center.x").alias("_x"), F.col("center.y").alias("_y"))
    met = f.withColumn("_gx", cell(F.col("_x"))).withColumn("_gy", cell(F.col("_y"))).join(unsent(crossed_cells(s, zone, grown=True)), ["image_id", "_gx", "_gy"])
    near = _nearest(met.withColumn("_d", point_to_segment(F.col("_x"), F.col("_y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).where(F.col("_d") <= zone))
    if beyond:
        near = cut(near)
        near = near.unionByName(_far(f.join(near, [*FIBER], "left_anti"), s, zone))
    return fibers.drop("distance_to_boundary", "angle_to_tangent").join(unsent(near), [*FIBER], "left")


def _far(f: DataFrame, segs: DataFrame, size: float) -> DataFrame:
    """The nearest segments of fibres at any distance.

    Cells that hold a piece of an outline form levels, each twice as coarse, up to a few cells an image. A fibre goes down the levels with the cells
    that may hold its nearest segment: those not further off than the farthest corner of the best one. Only segments in the last cells are measured.
    """
    crossing = cut(crossed_cells(segs, size))
    level = crossing.select("image_id", "_gx", "_gy").distinct()
    levels = [cut(level)]
    # one number comes to the driver: how many cells the widest image spans
    span = levels[0].groupBy("image_id").agg(F.max("_gx") - F.min("_gx"), F.max("_gy") - F.min("_gy")).toDF("i", "x", "y").agg(F.max(F.greatest("x", "y"))).first()[0] or 0
    for _ in range(int(span).bit_length()):
        levels.append(cut(levels[-1].select("image_id", F.shiftright("_gx", 1).alias("_gx"), F.shiftright("_gy", 1).alias("_gy")).distinct()))
    met = f.where(FINITE(F.col("_x")) & FINITE(F.col("_y"))).join(levels[-1], "image_id")
    for k in range(len(levels) - 1, -1, -1):
        wide = size * (1 << k)
        if k < len(levels) - 1:
            finer = levels[k].select("image_id", F.shiftright("_gx", 1).alias("_px"), F.shiftright("_gy", 1).alias("_py"), "_gx", "_gy")
            met = met.select(*f.columns, F.col("_gx").alias("_px"), F.col("_gy").alias("_py")).join(finer, ["image_id", "_px", "_py"])
        gap = lambda v, c: F.greatest(F.lit(0.0), F.col(c) * wide - F.col(v), F.col(v) - (F.col(c) + 1) * wide)  # noqa: B023, E731
        most = lambda v, c: F.greatest(F.abs(F.col(v) - F.col(c) * wide), F.abs(F.col(v) - (F.col(c) + 1) * wide))  # noqa: B023, E731
        bound = F.min(F.hypot(most("_x", "_gx"), most("_y", "_gy"))).over(Window.partitionBy(*FIBER))
        met = met.withColumn("_bound", bound).where(F.hypot(gap("_x", "_gx"), gap("_y", "_gy")) <= F.col("_bound") * (1 + 1e-9) + 1e-6).select(*f.columns, "_gx", "_gy")
        met = cut(met)
    found = met.join(crossing, ["image_id", "_gx", "_gy"])
    return _nearest(found.withColumn("_d", point_to_segment(F.col("_x"), F.col("_y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))))


def classify_tacs(fibers: DataFrame, parallel: float = 30.0, perpendicular: float = 60.0, straight: float = 0.8) -> DataFrame:
    """tacs by the angle to the tangent: TACS-3 perpendicular and straight, TACS-2 parallel and straight, else TACS-1; null outside the zone. The cut-offs are ours."""
    a, s = F.col("angle_to_tangent"), F.coalesce("straightness", F.lit(0.0)) >= straight
    tacs = F.when(F.col("distance_to_boundary").isNull(), None).when((a >= perpendicular) & s, "TACS-3").when((a <= parallel) & s, "TACS-2").otherwise("TACS-1")
    return fibers.drop("tacs").withColumn("tacs", tacs)


def rasterize_polygon(rings: DataFrame, regions: DataFrame) -> DataFrame:
    """Pixels (image_id, annotation_id, x, y) whose centre is inside, by the even-odd rule over all parts; regions: image_id, x, y, width, height, downsample."""
    r = regions.select("image_id", F.col("x").alias("_ox"), F.col("y").alias("_oy"), F.col("downsample").alias("_d"), F.ceil(F.col("width") / F.col("downsample")).cast("int").alias("_w"), F.ceil(F.col("height") / F.col("downsample")).cast("int").alias("_h"))
    s = segments(rings).join(r, "image_id")
    for c, o in (("ax", "_ox"), ("bx", "_ox"), ("ay", "_oy"), ("by", "_oy")):
        s = s.withColumn(c, (F.col(c) - F.col(o)) / F.col("_d"))
    # rows whose centre line the edge crosses (half-open, so that a shared vertex counts once)
    first, last = F.greatest(F.ceil(F.least("ay", "by") - 0.5), F.lit(0)), F.least(F.ceil(F.greatest("ay", "by") - 0.5) - 1, F.col("_h") - 1)
    rows = s.withColumn("_f", first).withColumn("_l", last).where("_f <= _l").withColumn("y", F.explode(F.sequence("_f", "_l")))
    cross = rows.withColumn("_c", F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    w = Window.partitionBy("image_id", "annotation_id", "y").orderBy("_c", "part_id", "seg")
    spans = cross.withColumn("_n", F.row_number().over(w)).withColumn("_to", F.lead("_c").over(w)).where("_n % 2 = 1 and _to is not null")
    x0, x1 = F.greatest(F.ceil(F.col("_c") - 0.5), F.lit(0)), F.least(F.ceil(F.col("_to") - 0.5) - 1, F.col("_w") - 1)
    filled = spans.withColumn("_f", x0).withColumn("_l", x1).where("_f <= _l").withColumn("x", F.explode(F.sequence("_f", "_l")))
    return filled.select("image_id", "annotation_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


#: Side of the blocks in which lines are drawn, and lines that are drawn at once.
SIDE, AT_ONCE = 256, 256


def drawn(s: dict[str, np.ndarray], left: int, top: int, half: float) -> np.ndarray:
    """The pixels within `half` of some segments (ax, ay, bx, by; w, h: sizes of their image) in the block that begins at left, top."""
    out = np.zeros((SIDE, SIDE), bool)

    def each(lo: np.ndarray, hi: np.ndarray, size: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Which segment, and the whole number, for all from lo - half to hi + half in the image and the block."""
        f = np.maximum(np.ceil(lo - half), max(0, first)).astype(np.int64)
        n = np.maximum(np.minimum(np.minimum(np.floor(hi + half), size - 1), first + SIDE - 1).astype(np.int64) - f + 1, 0)
        of = np.repeat(np.arange(len(n)), n)
        return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + f[of]

    for i in range(0, len(s["ax"]), AT_ONCE):
        part = {k: v[i : i + AT_ONCE] for k, v in s.items()}
        lo, hi = np.minimum(part["ay"], part["by"]), np.maximum(part["ay"], part["by"])
        of, y = each(lo, hi, part["_h"], top)
        row = {k: v[of] for k, v in part.items()}
        dx, dy = row["bx"] - row["ax"], row["by"] - row["ay"]
        level = np.abs(dy) < 1e-9
        # in a row, only the columns that the line's part near the row can reach
        at = lambda v: row["ax"] + (np.clip(v, lo[of], hi[of]) - row["ay"]) / np.where(level, 1.0, dy) * dx  # noqa: B023, E731
        xa, xb = np.where(level, row["ax"], at(y - half)), np.where(level, row["bx"], at(y + half))
        of, x = each(np.minimum(xa, xb), np.maximum(xa, xb), row["_w"], left)
        ax, ay, dx, dy, y = row["ax"][of], row["ay"][of], dx[of], dy[of], y[of]
        square = dx * dx + dy * dy
        t = np.where(square > 0, np.clip(((x - ax) * dx + (y - ay) * dy) / np.where(square > 0, square, 1.0), 0.0, 1.0), 0.0)
        ex, ey = ax + t * dx - x, ay + t * dy - y
        near = np.sqrt(ex * ex + ey * ey) <= half
        out[y[near] - top, x[near] - left] = True
    return out


def rasterize_fibers(fibers: DataFrame, width: int | str, height: int | str, thickness: float = 5) -> DataFrame:
    """Pixels (image_id, x, y) within half the thickness of a fibre's line. width, height: of all images, or the names of columns that hold each image's.

    Segments go to the blocks of SIDE x SIDE pixels that they may reach and are drawn there, so that a pixel arises once and no pixel is shuffled.
    """
    half = max(1, round(thickness)) / 2
    p = F.col("points")
    size = lambda n: F.col(n) if isinstance(n, str) else F.lit(n)
    s = fibers.where(F.size(p) >= 2).select("image_id", size(width).cast("double").alias("_w"), size(height).cast("double").alias("_h"), F.explode(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(F.get(p, i - 1).alias("a"), F.get(p, i).alias("b")))).alias("s"))
    ends = ("ax", "ay", "bx", "by")
    s = s.select("image_id", "_w", "_h", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    for c in ends:
        s = s.where(FINITE(F.col(c)))

    def blocks(a: str, b: str, n: str) -> Column:
        lo, hi = F.greatest(F.least(a, b) - half, F.lit(0.0)), F.least(F.greatest(a, b) + half, F.col(n) - 1)
        of = lambda v: F.floor(v / F.lit(SIDE)).cast("int")
        return F.explode(F.when(lo <= hi, F.sequence(of(lo), of(hi))).otherwise(F.array().cast("array<int>")))

    put = s.withColumn("_left", blocks("ax", "bx", "_w")).withColumn("_top", blocks("ay", "by", "_h"))

    def draw(block: pa.Table) -> pa.Table:
        left, top = (block[c][0].as_py() * SIDE for c in ("_left", "_top"))
        y, x = np.nonzero(drawn({c: block[c].to_numpy() for c in (*ends, "_w", "_h")}, left, top, half))
        image = block["image_id"].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(x), np.int64)))
        return pa.table({"image_id": image, "x": pa.array((x + left).astype(np.int32)), "y": pa.array((y + top).astype(np.int32))})

    kind = fibers.select("image_id").schema["image_id"].dataType
    return dealt(put, "image_id", "_left", "_top").groupBy("image_id", "_left", "_top").applyInArrow(draw, T.StructType([T.StructField("image_id", kind), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))


def coverage(foreground: DataFrame, fiber_pixels: DataFrame) -> DataFrame:
    """Per image: foreground pixels, those under fibres, and their share."""
    f = fiber_pixels.select("image_id", "x", "y", F.lit(1).alias("_in"))
    met = foreground.select("image_id", "x", "y").join(unsent(f), ["image_id", "x", "y"], "left")
    a = met.groupBy("image_id").agg(F.count(F.lit(1)).alias("foreground"), F.sum(F.coalesce("_in", F.lit(0))).alias("covered"))
    return a.withColumn("coverage", F.col("covered") / F.col("foreground"))


def lines_in_parts(lines: DataFrame, rings: DataFrame, band: float = 64.0) -> DataFrame:
    """Hand-traced lines of at least two points whose centroid (mean of points) is inside a part (even-odd): image_id, line_id, annotation_id, part_id.

    Lines meet only the segments that reach into their band of y.
    """
    n = F.size("points")
    mean = lambda c: F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p[c]) / n
    of = lambda y: F.floor(y / F.lit(float(band)))
    p = lines.where(n >= 2).select("image_id", "line_id", mean("x").alias("_x"), mean("y").alias("_y")).withColumn("_band", of(F.col("_y")))
    s = segments(rings).where("ay <> by").withColumn("_band", F.explode(F.sequence(of(F.least("ay", "by")), of(F.greatest("ay", "by")))))
    crosses = ((F.col("ay") > F.col("_y")) != (F.col("by") > F.col("_y"))) & (F.col("_x") < F.col("ax") + (F.col("_y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    keys = ["image_id", "line_id", "annotation_id", "part_id"]
    return p.join(s, ["image_id", "_band"]).where(crosses).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select(*keys)
