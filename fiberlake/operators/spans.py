"""Masks as spans of rows (image_id, y, x0, x1, both ends inside): joined, met and measured by sweeps over their ends, without a row for each pixel.

All windows are by row of an image. Spans may overlap or repeat unless they come from `union`; one that ends before it starts is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = ("image_id", "y")


def runs(pixels: DataFrame) -> DataFrame:
    """The spans of pixels (image_id, x, y); repeated ones count once."""
    rank = F.dense_rank().over(Window.partitionBy(*ROW).orderBy("x"))
    return pixels.select(*ROW, "x", (F.col("x") - rank).alias("_run")).groupBy(*ROW, "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_run")


def union(spans: DataFrame) -> DataFrame:
    """Spans that overlap or touch become one."""
    w = Window.partitionBy(*ROW).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.where("x0 <= x1").select(*ROW, "x0", "x1", F.when(reach.isNull() | (F.col("x0") > reach + 1), 1).otherwise(0).alias("_new"))
    of = new.withColumn("_of", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return of.groupBy(*ROW, "_of").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_of")


def _swept(a: DataFrame, b: DataFrame, keep: Column) -> DataFrame:
    """The spans over which keep holds; it sees in_a and in_b, the number of spans of either that are open."""
    ends = lambda s, own, other: s.where("x0 <= x1").select(*ROW, F.explode(F.array(F.struct(F.col("x0").cast("long").alias("x"), F.lit(1).alias("n")), F.struct((F.col("x1") + 1).cast("long").alias("x"), F.lit(-1).alias("n")))).alias("_e")).select(*ROW, "_e.x", F.col("_e.n").alias(own), F.lit(0).alias(other))
    events = ends(a, "a", "b").unionByName(ends(b, "b", "a")).groupBy(*ROW, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*ROW).orderBy("x")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = events.select(*ROW, F.col("x").alias("x0"), (F.lead("x").over(w) - 1).alias("x1"), F.sum("a").over(so_far).alias("in_a"), F.sum("b").over(so_far).alias("in_b"))
    return union(pieces.where(keep & F.col("x1").isNotNull()).select(*ROW, "x0", "x1"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _swept(a, b, (F.col("in_a") > 0) & (F.col("in_b") > 0))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is in a and not in b."""
    return _swept(a, b, (F.col("in_a") > 0) & (F.col("in_b") == 0))


def areas(spans: DataFrame) -> DataFrame:
    """image_id, pixels; overlaps count once."""
    return union(spans).groupBy("image_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))


def pixels_of(spans: DataFrame) -> DataFrame:
    """image_id, x, y of every pixel, each once."""
    each = union(spans).select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return each.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def inside(pixels: DataFrame, spans: DataFrame, name: str = "inside") -> DataFrame:
    """pixels (image_id, x, y and more) with a column that says whether a span holds them. Each row of an image brings the list of its spans; no mask of pixels arises."""
    rows = union(spans).groupBy(*ROW).agg(F.collect_list(F.struct("x0", "x1")).alias("_spans"))
    return pixels.join(rows, [*ROW], "left").withColumn(name, F.coalesce(F.exists("_spans", lambda s: (F.col("x") >= s["x0"]) & (F.col("x") <= s["x1"])), F.lit(False))).drop("_spans")


def coverage(foreground: DataFrame, covering: DataFrame) -> DataFrame:
    """Per image: foreground pixels, those under the covering spans, and their share."""
    both = areas(intersection(foreground, covering)).withColumnRenamed("pixels", "covered")
    a = areas(foreground).withColumnRenamed("pixels", "foreground").join(both, "image_id", "left").fillna(0, ["covered"])
    return a.withColumn("coverage", F.col("covered") / F.col("foreground"))
