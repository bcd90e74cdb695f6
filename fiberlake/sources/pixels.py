"""Reading images and annotations, writing fibres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberlake import schemas
from fiberlake.functions.geometry import point

#: Values of an image that become rows at once.
PIECE = 1 << 20


def read_pixels(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Long pixel rows from a Parquet pixel table, or from 8-bit images through Spark's image source (Blue, Green, Red order is the source's)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    i = images.select(F.xxhash64("image.origin").alias("image_id"), "image.width", "image.nChannels", F.col("image.data").alias("data"))
    return i.mapInPandas(_pixel_rows, "image_id long, channel int, x int, y int, value double")


def _pixel_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The values of each image buffer (rows, then columns, then channels), some of its rows at a time."""
    for pdf in batches:
        for image_id, width, channels, data in pdf.itertuples(index=False):
            values = np.frombuffer(data, np.uint8)
            step = max(1, PIECE // (width * channels)) * width * channels
            for lo in range(0, len(values), step):
                part = values[lo : lo + step]
                at = np.arange(lo, lo + len(part))
                yield pd.DataFrame({"image_id": image_id, "channel": at % channels, "x": at // channels % width, "y": at // (channels * width), "value": part.astype(float)})


def read_truth_lines(spark: SparkSession, path: str) -> DataFrame:
    """Hand-traced lines from GeoJSON features, one feature a line: image_id, line_id, class, name, points. Lines of fewer than two points are left out."""
    schema = "image_id long, id int, geometry struct<type: string, coordinates: string>, properties struct<classification: struct<name: string>, name: string>"
    f = spark.read.schema(schema).json(path).where("geometry.type = 'LineString'")
    lines = f.select("image_id", F.col("id").cast("long").alias("line_id"), F.col("properties.classification.name").alias("class"), F.col("properties.name").alias("name"), F.from_json("geometry.coordinates", "array<array<double>>").alias("v"))
    return lines.where(F.size("v") >= 2).select("image_id", "line_id", "class", "name", F.transform("v", lambda p: point(p[0], p[1])).alias("points"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rings from GeoJSON features, one feature a line: image_id, annotation_id, class, name, part_id, ring_id, vertices."""
    geometry = "struct<type: string, coordinates: string>"
    schema = f"image_id long, id int, geometry {geometry}, properties struct<classification: struct<name: string>, name: string>"
    f = spark.read.schema(schema).json(path)
    rings = "array<array<array<double>>>"
    parts = F.when(F.col("geometry.type") == "MultiPolygon", F.from_json("geometry.coordinates", f"array<{rings}>")).otherwise(F.array(F.from_json("geometry.coordinates", rings)))
    by_part = f.where("geometry.type in ('Polygon', 'MultiPolygon')").select("image_id", F.col("id").alias("annotation_id"), F.col("properties.classification.name").alias("class"), F.col("properties.name").alias("name"), F.posexplode(parts).alias("part_id", "rings"))
    by_ring = by_part.select("image_id", "annotation_id", "class", "name", "part_id", F.posexplode("rings").alias("ring_id", "v"))
    return by_ring.select("image_id", "annotation_id", "class", "name", "part_id", "ring_id", F.transform("v", lambda p: point(p[0], p[1])).alias("vertices"))


def fibers_from_json(responses: DataFrame, column: str = "response") -> DataFrame:
    """Fibre rows from analysis responses; other columns stay beside them. Broken JSON gives no fibres."""
    parsed = responses.withColumn("_r", F.from_json(column, schemas.RESPONSE_JSON)).drop(column)
    keep = [c for c in parsed.columns if c != "_r"]
    f = parsed.select(*keep, F.explode("_r.fibers").alias("f"))
    nan = lambda c: F.when(F.isnan(c), None).otherwise(c)
    return f.select(
        *keep, F.col("f.id").alias("fiber_id"), F.transform("f.points", lambda p: point(p[0], p[1])).alias("points"), point(F.col("f.center")[0], F.col("f.center")[1]).alias("center"),
        "f.angle", "f.length_arc", "f.length_end", nan(F.col("f.width")).alias("width"), nan(F.col("f.straightness")).alias("straightness"), "f.tacs", "f.angle_to_tangent", "f.distance_to_boundary",
    )


def fibers_to_json(fibers: DataFrame, by: list[str]) -> DataFrame:
    """One response for each group, fibres in order of id."""
    pair = lambda p: F.array(p["x"], p["y"])
    fiber = F.struct(
        F.col("fiber_id").alias("id"), F.transform("points", pair).alias("points"), pair(F.col("center")).alias("center"),
        *["angle", "length_arc", "length_end", "width", "straightness", "tacs", "angle_to_tangent", "distance_to_boundary"],
    )
    rows = F.sort_array(F.collect_list(fiber))
    return fibers.groupBy(*by).agg(rows.alias("_f")).select(*by, F.to_json(F.struct(F.lit(True).alias("ok"), F.size("_f").alias("n_fibers"), F.col("_f").alias("fibers"))).alias("response"))
