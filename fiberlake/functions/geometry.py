"""Column expressions on points, segments and polylines. Angles are undirected degrees in [0, 180), y pointing down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def undirected(degrees: Column) -> Column:
    """Into [0, 180); adding zero turns -0.0 into 0.0."""
    return F.pmod(degrees, F.lit(180.0)) + F.lit(0.0)


def axis_angle(dx: Column, dy: Column) -> Column:
    return undirected(F.degrees(F.atan2(-dy, dx)))


def acute_difference(a: Column, b: Column) -> Column:
    """Between two undirected angles, in [0, 90]."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up, as a double."""
    scale = F.lit(10.0**digits)
    return F.floor(x * scale + F.lit(0.5)) / scale


def arc_length(points: Column) -> Column:
    step = lambda acc, i: acc + distance(F.get(points, i - 1)["x"], F.get(points, i - 1)["y"], F.get(points, i)["x"], F.get(points, i)["y"])
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), F.lit(0.0), step))


def first_point(points: Column) -> Column:
    return F.get(points, F.lit(0))


def last_point(points: Column) -> Column:
    return F.element_at(points, -1)


def middle_vertex(points: Column) -> Column:
    """The vertex at n // 2, which is the centre of a traced fibre (neither centroid nor midpoint)."""
    return F.get(points, F.floor(F.size(points) / 2).cast("int"))


def end_length(points: Column) -> Column:
    a, b = first_point(points), last_point(points)
    return distance(a["x"], a["y"], b["x"], b["y"])


def end_angle(points: Column) -> Column:
    a, b = first_point(points), last_point(points)
    return axis_angle(b["x"] - a["x"], b["y"] - a["y"])


def straightness(arc: Column, end: Column) -> Column:
    return F.when(arc > 0, end / arc).otherwise(F.lit(0.0))


def segment_from_center(center: Column, angle: Column, length: Column) -> Column:
    """The two ends of a straight fibre."""
    dx, dy = length / 2 * F.cos(F.radians(angle)), length / 2 * F.sin(F.radians(angle))
    return F.array(point(center["x"] - dx, center["y"] + dy), point(center["x"] + dx, center["y"] - dy))


def moved(points: Column, dx, dy) -> Column:
    return F.transform(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def to_full(points: Column, ox, oy, downsample) -> Column:
    return F.transform(points, lambda p: point(ox + p["x"] * downsample, oy + p["y"] * downsample))


def to_local(points: Column, ox, oy, downsample) -> Column:
    return F.transform(points, lambda p: point((p["x"] - ox) / downsample, (p["y"] - oy) / downsample))


def shoelace(vertices: Column) -> Column:
    """Area of a ring, whichever way it runs."""
    n = F.size(vertices)
    at = lambda i: F.get(vertices, (i % n).cast("int"))
    total = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda acc, i: acc + F.coalesce(at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"], F.lit(0.0)))
    return F.abs(total) / 2


def tacs_rgb(tacs: Column, preview: bool = False) -> Column:
    """Colours by class; fixed values. Fibres without a class are grey as objects and lime in a preview."""
    if preview:
        return F.when(tacs == "TACS-3", "255,0,0").when(tacs == "TACS-2", "50,205,50").when(tacs == "TACS-1", "30,144,255").otherwise("0,255,0")
    return F.when(tacs == "TACS-3", "255,0,0").when(tacs == "TACS-2", "0,220,0").when(tacs == "TACS-1", "0,110,255").otherwise("128,128,128")
