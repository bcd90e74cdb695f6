"""Column types of the engine's tables."""

from __future__ import annotations

POINT = "struct<x: double, y: double>"
POINTS = f"array<{POINT}>"
PIXELS = "image_id long, channel int, x int, y int, value double"
FIBERS = f"image_id long, tile_id int, fiber_id long, points {POINTS}, center {POINT}, angle double, length_arc double, length_end double, width double, straightness double, tacs string, angle_to_tangent double, distance_to_boundary double"
RINGS = f"image_id long, annotation_id int, part_id int, vertices {POINTS}"
#: A fibre as the analysis service writes it: points and center are [x, y] pairs.
FIBER_JSON = "struct<id: long, points: array<array<double>>, center: array<double>, angle: double, length_arc: double, length_end: double, width: double, straightness: double, tacs: string, angle_to_tangent: double, distance_to_boundary: double>"
RESPONSE_JSON = f"struct<ok: boolean, n_fibers: int, fibers: array<{FIBER_JSON}>>"
