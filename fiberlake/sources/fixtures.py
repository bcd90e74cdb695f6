"""Fibre-network tables as projections of star-schema tables: Spark and the same in DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberlake.functions.geometry import point
from fiberlake.operators.rounds import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px_scan(spark, sf_dir) -> DataFrame:
    """One tall, narrow float image with negative values."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("channel"), F.posexplode("embedding").alias("x", "v"), F.col("vec_id").alias("y")).select("image_id", "channel", "x", "y", F.col("v").cast("double").alias("value"))


def px_multi(spark, sf_dir) -> DataFrame:
    """Sparse images of seven channels, 128 x 128; their number grows with the orders."""
    li = table(spark, sf_dir, "lineitem")
    keys = [F.floor(F.col("l_orderkey") / 4096).alias("image_id"), (F.col("l_linenumber") - 1).cast("int").alias("channel"), (F.col("l_partkey") % 128).cast("int").alias("x"), (F.col("l_orderkey") % 128).cast("long").alias("y")]
    return li.groupBy(*keys).agg(F.max(F.col("l_extendedprice").cast("double")).alias("value"))


SIDE = 96


def drawn_lines(spark, sf_dir) -> DataFrame:
    """Lines of three pixels' thickness in four directions, four to an image: image_id, k, dir, x0, y0, n (pixels along the line)."""
    k = F.col("s_suppkey").cast("long")
    s = table(spark, sf_dir, "supplier").select(F.floor(k / 4).alias("image_id"), k.alias("k"), (k % 4).cast("int").alias("dir"), (34 + k * 11 % 30).cast("int").alias("n"))
    x0 = F.when(F.col("dir") == 1, 10 + F.col("k") * 31 % 70).otherwise(6 + F.col("k") * 37 % 22)
    y0 = F.when(F.col("dir") == 0, 10 + F.col("k") * 29 % 70).when(F.col("dir") == 3, 6 + F.col("k") * 53 % 22 + F.col("n")).otherwise(6 + F.col("k") * 53 % 22)
    return s.select("image_id", "k", "dir", x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), "n")


def grid(images: DataFrame, side: int) -> DataFrame:
    """Every x and y of side x side beside each row."""
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    return images.withColumn("y", every).withColumn("x", every)


def px_lines(spark, sf_dir) -> DataFrame:
    """Dense images of SIDE x SIDE with planted lines on a faint ground; their number grows with the suppliers. Pixels arise where the few lines of their image are, so none is moved."""
    # an image has one line of a direction at most, so lines are columns; a function over an array of lines takes most of the time of a query on these images
    lines = dealt(drawn_lines(spark, sf_dir), "image_id").groupBy("image_id").agg(*[F.max(F.when(F.col("dir") == k, F.col(c))).alias(f"_{c}{k}") for k in range(4) for c in ("x0", "y0", "n")])
    x, y = F.col("x"), F.col("y")

    def drawn(k: int) -> Column:
        x0, y0, n = (F.col(f"_{c}{k}") for c in ("x0", "y0", "n"))
        i = x - x0 if k == 0 else y0 - y if k == 3 else y - y0
        off = y - y0 if k == 0 else x - x0 if k == 1 else x - x0 - i
        return (i >= 0) & (i < n) & (F.abs(off) <= 1)

    value = F.when(drawn(0) | drawn(1) | drawn(2) | drawn(3), F.lit(200.0)).otherwise(((x * 7 + y * 13) % 3).cast("double"))
    return grid(lines, SIDE).select("image_id", F.lit(0).alias("channel"), "x", "y", value.alias("value"))


def truth_lines(spark, sf_dir) -> DataFrame:
    """The axes of the planted lines, as hand-traced lines."""
    at = lambda i: point(F.col("x0") + i * F.when(F.col("dir") == 1, 0.0).otherwise(1.0), F.col("y0") + i * F.when(F.col("dir") == 0, 0.0).when(F.col("dir") == 3, -1.0).otherwise(1.0))
    return drawn_lines(spark, sf_dir).select("image_id", F.col("k").alias("line_id"), F.array(at(F.lit(0.0)), at(F.col("n") - 1.0)).alias("points"))


CURVED = 128


def planted_curves(spark, sf_dir) -> DataFrame:
    """Waves, two to an image: image_id, line_id, x, y (their axis, a row for each column of pixels)."""
    k = F.col("s_suppkey").cast("long")
    s = table(spark, sf_dir, "supplier").select(F.floor(k / 2).alias("image_id"), k.alias("line_id"), (32 + 64 * (k % 2)).alias("y0"), (4 + k * 5 % 9).alias("high"), (70 + k * 7 % 50).alias("long"), (k * 13 % 100).alias("turn"))
    on = s.withColumn("x", F.explode(F.sequence(F.lit(8), F.lit(CURVED - 9))))
    return on.select("image_id", "line_id", "x", (F.col("y0") + F.col("high") * F.sin(2 * math.pi * (F.col("x") / F.col("long") + F.col("turn") / 100))).alias("y"))


def px_curves(spark, sf_dir) -> DataFrame:
    """Dense noisy images of CURVED x CURVED with planted waves five pixels thick; their number grows with the suppliers. Pixels arise where the curves of their image are, so none is moved."""
    axes = dealt(planted_curves(spark, sf_dir).select("image_id", "x", F.floor(F.col("y") + 0.5).cast("int").alias("at")), "image_id").groupBy("image_id", "x").agg(F.collect_list("at").alias("_at"))
    columns = axes.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("x", "_at"))).alias("_columns"))
    x, y = F.col("x"), F.col("y")
    put = columns.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(CURVED - 1)))).select("image_id", "x", F.coalesce(F.try_element_at("_columns", x), F.array().cast("array<int>")).alias("_at"))
    noise = (x * x * 7 + y * y * 13 + x * y * 5 + F.col("image_id") * 11) % 61
    lit = F.when(F.exists("_at", lambda at: F.abs(at - y) <= 2), 150).otherwise(0)
    return put.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(CURVED - 1)))).select("image_id", F.lit(0).alias("channel"), "x", "y", (lit + noise).cast("double").alias("value"))


def oriented_seeds(spark, sf_dir) -> DataFrame:
    """The tracer's vertices as seeds with directions."""
    turn = F.radians(F.col("vertex_id") * 37 % 180)
    return vertices(spark, sf_dir).select("image_id", F.col("vertex_id").alias("seed_id"), "x", "y", F.cos(turn).alias("ux"), F.sin(turn).alias("uy"))


def vertices(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day_us = 86_400_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("vertex_id"),
        F.floor(F.col("user_id") / 15).alias("image_id"),
        (F.col("user_id") % 4).alias("tile_id"),
        (F.col("user_id") * 1000 + F.day("ts")).alias("fiber_id"),
        ((micros % day_us) / F.lit(float(day_us)) * 512).alias("x"),
        F.least(F.col("value"), F.lit(511.0)).alias("y"),
        (1 + (F.col("event_id") % 7) / F.lit(2.0)).alias("radius"),
    )


def raw_fibers(spark, sf_dir) -> DataFrame:
    """Traced polylines of at least two points, left to right."""
    v = vertices(spark, sf_dir).groupBy("image_id", "tile_id", "fiber_id").agg(F.sort_array(F.collect_list(F.struct(F.col("x").alias("k"), "vertex_id", "y"))).alias("p"), F.avg("radius").alias("r"))
    return v.where(F.size("p") >= 2).select("image_id", "tile_id", "fiber_id", F.transform("p", lambda q: point(q["k"], q["y"])).alias("points"))


PART_0 = ((208, 64), (222, 30), (256, 16), (290, 30), (304, 64), (290, 98), (256, 112), (222, 98))
PART_1 = ((400, 20), (460, 20), (430, 110))
ZERO_AREA = ((10, 10), (20, 20), (10, 10))


def _ring(part: int, vertices) -> str:
    inner = ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in vertices)
    return f"named_struct('part_id', {part}, 'vertices', array({inner}))"


def rings(images: DataFrame, zero_area: bool = False) -> DataFrame:
    """The boundary outline of each image, in two parts (three with one of no area)."""
    parts = [PART_0, PART_1, *([ZERO_AREA] if zero_area else [])]
    every = F.explode(F.expr(f"array({', '.join(_ring(i, p) for i, p in enumerate(parts))})"))
    return images.select("image_id").distinct().select("image_id", F.lit(0).alias("annotation_id"), every.alias("r")).select("image_id", "annotation_id", "r.part_id", "r.vertices")


def gt_lines(fibers: DataFrame) -> DataFrame:
    """Hand-traced lines: every fifth fibre moved by (+3, -2)."""
    return fibers.where("fiber_id % 5 = 0").select("image_id", F.col("fiber_id").alias("line_id"), F.transform("points", lambda p: point(p["x"] + 3, p["y"] - 2)).alias("points"))


def tile_stats(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.floor(F.col("user_id") / 15).alias("image_id"), (F.col("user_id") % 4).alias("tile_id"), (F.col("event_type") != "error").alias("ok"),
        F.floor("value").cast("int").alias("n_traced"), F.floor(F.col("value") / 2).cast("int").alias("n_length_dropped"), (F.col("event_id") % 3).cast("int").alias("n_width_dropped"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )


def _sql_ring(vertices) -> str:
    return "[" + ", ".join(f"{{'x': {x}::double, 'y': {y}::double}}" for x, y in vertices) + "]"


#: DuckDB's form of the same tables, as common table expressions.
SQL = {
    "px_scan": "px_scan as (select 0::bigint image_id, 0 channel, (i - 1)::int x, vec_id y, embedding[i]::double as value from embeddings, unnest(range(1, len(embedding) + 1)) t(i))",
    "px_multi": "px_multi as (select l_orderkey::bigint // 4096 image_id, (l_linenumber - 1)::int channel, (l_partkey % 128)::int x, (l_orderkey % 128)::bigint y, max(l_extendedprice::double) as value from lineitem group by l_orderkey::bigint // 4096, l_linenumber - 1, l_partkey % 128, l_orderkey % 128)",
    "px_lines": """drawn as (select s_suppkey::bigint // 4 image_id, s_suppkey::bigint k, s_suppkey % 4 dir, 34 + s_suppkey::bigint * 11 % 30 n, case when s_suppkey % 4 = 1 then 10 + s_suppkey::bigint * 31 % 70 else 6 + s_suppkey::bigint * 37 % 22 end x0,
case when s_suppkey % 4 = 0 then 10 + s_suppkey::bigint * 29 % 70 when s_suppkey % 4 = 3 then 6 + s_suppkey::bigint * 53 % 22 + 34 + s_suppkey::bigint * 11 % 30 else 6 + s_suppkey::bigint * 53 % 22 end y0 from supplier),
lit_px as (select image_id, x0 + i * case when dir = 1 then 0 else 1 end + case when dir = 0 then 0 else o end x, y0 + i * case when dir = 0 then 0 when dir = 3 then -1 else 1 end + case when dir = 0 then o else 0 end y from (select *, unnest(range(n)) i from drawn), (values (-1), (0), (1)) v(o)),
px_lines as (select image_id, 0 channel, x, y, max(v) as value from (select image_id, x, y, 200.0::double v from lit_px union all select image_id, x, y, ((x * 7 + y * 13) % 3)::double from (select distinct image_id from drawn), range(96) a(x), range(96) b(y)) group by image_id, x, y)""",
    "vertices": "vertices as (select event_id vertex_id, user_id // 15 image_id, user_id % 4 tile_id, user_id * 1000 + day(ts) fiber_id, (epoch_us(ts) % 86400000000) / 86400000000::double * 512 x, least(value, 511::double) y, 1 + (event_id % 7) / 2::double radius from events)",
    "fibers": "raw_fibers as (select image_id, tile_id, fiber_id, list({'x': x, 'y': y} order by x, vertex_id) points from vertices group by image_id, tile_id, fiber_id having count(*) >= 2)",
    "rings": f"rings as (select image_id, 0 annotation_id, part_id, vertices from (select distinct image_id from raw_fibers), (values (0, {_sql_ring(PART_0)}), (1, {_sql_ring(PART_1)})) t(part_id, vertices))",
    "gt": "gt_lines as (select image_id, fiber_id line_id, [{'x': p.x + 3, 'y': p.y - 2} for p in points] points from raw_fibers where fiber_id % 5 = 0)",
    "tile_stats": "tile_stats as (select event_id, user_id // 15 image_id, user_id % 4 tile_id, event_type <> 'error' ok, floor(value)::int n_traced, floor(value / 2)::int n_length_dropped, (event_id % 3)::int n_width_dropped, ts event_time from events)",
}


def with_tables(*names: str) -> str:
    """"with ..." of the named tables and those that they need."""
    needs = {"fibers": ["vertices"], "rings": ["fibers"], "gt": ["fibers"], "measured": ["fibers"]}
    order: list[str] = []

    def add(n: str) -> None:
        for m in needs.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(SQL[n] for n in order)


# measured fibres: middle vertex, arc, ends, angle, straightness
SQL["measured"] = """fib as (select *, points[len(points) // 2 + 1] center, sqrt((points[-1].x - points[1].x) * (points[-1].x - points[1].x) + (points[-1].y - points[1].y) * (points[-1].y - points[1].y)) length_end,
list_sum([sqrt((points[i].x - points[i - 1].x) * (points[i].x - points[i - 1].x) + (points[i].y - points[i - 1].y) * (points[i].y - points[i - 1].y)) for i in range(2, len(points) + 1)]) length_arc,
case when degrees(atan2(-(points[-1].y - points[1].y), points[-1].x - points[1].x)) < 0 then (degrees(atan2(-(points[-1].y - points[1].y), points[-1].x - points[1].x)) + 180) % 180 else degrees(atan2(-(points[-1].y - points[1].y), points[-1].x - points[1].x)) % 180 end + 0.0::double angle,
case when len(points) % 4 = 3 then null else 2.0::double + (fiber_id % 60) end width from raw_fibers),
fibers as (select *, case when length_arc > 0 then length_end / length_arc else 0 end straightness from fib)"""
