"""Queries on pixel tables, tiles and detection, each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberlake.functions import geometry as g
from fiberlake.functions.params import native_to_threshold
from fiberlake.operators import detect, pixels, tiles
from fiberlake.operators.rounds import beside, shared_folder, written
from fiberlake.sources import fixtures as fx
from fiberlake.sources.pixel_store import PixelStore

R = g.rounded


def r6(e: str) -> str:
    return f"(floor(({e}) * 1000000.0::double + 0.5::double) / 1000000.0::double)"


def longs(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


STATS = """stats as (select image_id, channel, s[1] lo, s[-1] hi, len(s) n, s[1] norm_lo, case when s[floor(0.995::double * (len(s) - 1) + 0.5::double)::int + 1] > s[1] then s[floor(0.995::double * (len(s) - 1) + 0.5::double)::int + 1] when s[-1] > s[1] then s[-1] else s[1] + 1 end norm_hi,
s[floor(0.8::double * (len(s) - 1) + 0.5::double)::int + 1] threshold from (select image_id, channel, list_sort(list(value)) s from {px} group by image_id, channel))"""
GRAY = """gray as (select p.*, st.norm_lo, st.norm_hi, st.threshold, greatest(0, least(255, floor((value - norm_lo) * (255.0::double / case when norm_hi > norm_lo then norm_hi - norm_lo else 1 end) + 0.5::double)))::bigint g,
greatest(0, least(255, floor((threshold - norm_lo) / case when norm_hi > norm_lo then norm_hi - norm_lo else 1 end * 255.0::double + 0.5::double)))::bigint t from {px} p join stats st using (image_id, channel))"""


def gray_sql(px: str) -> str:
    return f"{fx.with_tables(px)},\n{STATS.format(px=px)},\n{GRAY.format(px=px)}"


def gray_of(px: DataFrame, single: bool = False) -> DataFrame:
    """g and the default threshold t on the grey scale. single: images of one channel, which stay where they are if they are dealt out by image."""
    s = written(pixels.channel_stats(px).select("image_id", "channel", "norm_lo", "norm_hi", "threshold"))
    met = px.join(s.drop("channel").hint("shuffle_hash"), "image_id") if single else px.join(beside(s), ["image_id", "channel"])
    out = pixels.to_gray(met, F.col("norm_lo"), F.col("norm_hi"))
    return out.withColumn("t", native_to_threshold(F.col("threshold"), F.col("norm_lo"), F.col("norm_hi")))


def px_scan(spark, d):
    return fx.px_scan(spark, d).select("image_id", *longs("channel", "x", "y"), R(F.col("value")).alias("value"))


def foreground_share(spark, d):
    gray = gray_of(fx.px_multi(spark, d))
    return gray.groupBy("image_id", *longs("channel")).agg(F.count(F.lit(1)).alias("n"), R(F.min("norm_lo")).alias("norm_lo"), R(F.max("norm_hi")).alias("norm_hi"), F.max("t").cast("long").alias("t"), R(F.avg(F.when(F.col("g") > F.col("t"), 1.0).otherwise(0.0))).alias("share"))


def crop(spark, d):
    p = fx.px_scan(spark, d)
    box = p.groupBy("image_id").agg(F.lit(3.4).alias("x"), (F.max("y") * 0.25 + 0.2).alias("y"), F.lit(20.3).alias("width"), (F.max("y") * 0.5).alias("height"))
    return pixels.crop(p, box).select("image_id", *longs("channel", "x", "y"), R(F.col("value")).alias("value"))


def downsample(spark, d):
    return pixels.downsample(fx.px_multi(spark, d), 2.5).select("image_id", *longs("channel", "x", "y"), R(F.col("value")).alias("value"))


REGION = (37.0, 20.0, 52.0, 68.0)


def region_reads(spark, d):
    """One region of every image from the pixel store, and the means over 4 x 4 pixels of the whole images, which start from its second level."""
    store = PixelStore(f"{shared_folder(spark)}/pixels-{uuid.uuid4().hex}", levels=3, block=16)
    store.write(fx.px_multi(spark, d))
    every = [(1, store.read(spark, [(None, *REGION)])), (4, store.read(spark, [(None, 0.0, 0.0, None, None)], 4.0))]
    return reduce(DataFrame.union, [p.select("image_id", *longs("channel", "x", "y"), F.lit(k).cast("long").alias("d"), R(F.col("value")).alias("value")) for k, p in every])


def channel_clamp(spark, d):
    return pixels.select_channel(fx.px_multi(spark, d), 99).select("image_id", *longs("channel", "x", "y"), R(F.col("value")).alias("value"))


def channel_stats(spark, d):
    both = fx.px_multi(spark, d).select("image_id", "channel", "value").union(fx.px_scan(spark, d).select(F.lit(-1).cast("long"), "channel", "value"))
    return pixels.channel_stats(both).select("image_id", *longs("channel", "n"), *[R(F.col(c)).alias(c) for c in ("lo", "hi", "norm_lo", "norm_hi", "threshold")])


def to_gray(spark, d):
    return gray_of(fx.px_scan(spark, d)).select("image_id", *longs("channel", "x", "y", "g"))


def gray_robust(spark, d):
    return pixels.to_gray_robust(fx.px_multi(spark, d)).select("image_id", *longs("channel", "x", "y", "g"))


def gray_max(spark, d):
    return pixels.to_gray_max(fx.px_multi(spark, d)).select("image_id", *longs("channel", "x", "y"), R(F.col("level")).alias("level"))


def threshold_mask(spark, d):
    return pixels.threshold_mask(gray_of(fx.px_scan(spark, d)), F.col("t")).select("image_id", *longs("channel", "x", "y", "g"))


def fraction_above(spark, d):
    return pixels.fraction_above(fx.px_multi(spark, d), 50_000.0).select("image_id", *longs("channel"), R(F.col("fraction")).alias("fraction"))


def _one_channel(spark, d) -> DataFrame:
    return gray_of(pixels.select_channel(fx.px_multi(spark, d), 0)).select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "g", "t")


def mask_outside(spark, d):
    gray = _one_channel(spark, d)
    disc = gray.where((F.col("x") - 64) * (F.col("x") - 64) + (F.col("y") - 64) * (F.col("y") - 64) <= 1600)
    return pixels.mask_outside(gray, disc).select("image_id", *longs("x", "y", "g"), "inside")


def gaussian_blur(spark, d):
    dense = pixels.dense(_one_channel(spark, d), 128, 128)
    return pixels.gaussian_blur(dense, 1.0).select("image_id", *longs("x", "y", "g"))


def _dense_mask(spark, d) -> DataFrame:
    dense = pixels.dense(_one_channel(spark, d).withColumn("g", F.when(F.col("g") > F.col("t"), 1).otherwise(0)), 128, 128)
    # background is rare in a dense image: grow it by blanking every seventh row's every fifth pixel
    return dense.select("image_id", "x", "y", (~((F.col("g") == 1) & ((F.col("x") + F.col("y")) % 3 == 0))).alias("inside"))


def distance_transform(spark, d):
    return pixels.distance_transform(_dense_mask(spark, d)).select("image_id", *longs("x", "y", "distance"))


def local_maxima(spark, d):
    dist = pixels.distance_transform(_dense_mask(spark, d))
    return pixels.local_maxima(dist, 6, 2).select("image_id", *longs("x", "y", "distance"))


def sobel_edges(spark, d):
    return pixels.thin_edges(pixels.dense(_one_channel(spark, d), 128, 128)).select("image_id", *longs("x", "y", "magnitude"), "strong")


def gray_lines(spark, d) -> DataFrame:
    """Dense grey images with planted lines."""
    return gray_of(fx.px_lines(spark, d), single=True).select("image_id", "x", "y", "g", "t", F.lit(fx.SIDE).alias("width"), F.lit(fx.SIDE).alias("height"))


def _points(spark, d) -> DataFrame:
    return detect.edge_points(gray_lines(spark, d), ["image_id"])


def edge_hysteresis(spark, d):
    return detect.edges(gray_lines(spark, d)).select("image_id", *longs("x", "y"))


def hough_votes(spark, d):
    return detect.peaks(detect.votes(written(_points(spark, d)), ["image_id"], 30), ["image_id"]).select("image_id", *longs("theta", "rho", "votes"))


def hough_segments(spark, d):
    s = detect.hough_segments(written(_points(spark, d)), ["image_id"])
    return s.select("image_id", *longs("seg_id", "theta", "rho", "votes", "pixels", "ax", "ay", "bx", "by"), R(F.col("length")).alias("length"))


def line_columns(f: DataFrame) -> DataFrame:
    ends = {f"{c}{i}": R(F.get("points", F.lit(i))[c]) for i in (0, 1) for c in "xy"}
    return f.select("image_id", *longs("fiber_id"), *[v.alias(k) for k, v in ends.items()], R(F.col("angle")).alias("angle"), R(F.col("length_arc")).alias("length_arc"))


def detect_lines(spark, d):
    return line_columns(detect.detect(gray_lines(spark, d), ["image_id"]))


def retry_dense(spark, d):
    gray = gray_of(fx.px_multi(spark, d))
    return detect.retry_dense(gray, ["image_id", "channel"], budget=4_000, threshold=100.0).select("image_id", *longs("channel", "foreground", "attempts"), R(F.col("threshold")).alias("threshold"), R(F.col("spacing")).alias("spacing"), "raised", "ok")


def regions(spark, d) -> DataFrame:
    """One region for each user group of the events."""
    e = fx.table(spark, d, "events").groupBy(F.floor(F.col("user_id") / 15).alias("image_id")).agg(F.max("event_id").alias("m"))
    return e.select("image_id", (F.col("m") % 100).cast("int").alias("x"), (F.col("m") % 50).cast("int").alias("y"), (300 + F.col("m") % 9000).cast("int").alias("width"), (200 + F.col("m") * 7 % 20000).cast("int").alias("height"), (1 + F.col("m") % 4 * 0.5).cast("double").alias("downsample"), F.when(F.col("m") % 3 == 0, None).otherwise(0.25 + F.col("m") % 5 * 0.1).cast("double").alias("pixel_size_um"), (F.col("m") % 100 + 300 + F.col("m") % 9000 - F.col("m") % 7 * 150).cast("int").alias("image_width"), (F.col("m") % 50 + 200 + F.col("m") * 7 % 20000 + 20 - F.col("m") % 3 * 30).cast("int").alias("image_height"))


REGIONS = "regions as (select image_id, (m % 100)::int x, (m % 50)::int y, (300 + m % 9000)::int width, (200 + m * 7 % 20000)::int height, (1 + m % 4 * 0.5::double) downsample, case when m % 3 = 0 then null else 0.25::double + m % 5 * 0.1::double end pixel_size_um, (m % 100 + 300 + m % 9000 - m % 7 * 150)::int image_width, (m % 50 + 200 + m * 7 % 20000 + 20 - m % 3 * 30)::int image_height from (select user_id // 15 image_id, max(event_id) m from events group by user_id // 15))"
TILES = """sized as (select *, ceil(width / downsample)::int w, ceil(height / downsample)::int h from regions),
shrink as (select image_id, greatest(1, ceil(w / 768.0::double))::int c, greatest(1, ceil(h / 768.0::double))::int r from sized
 union all select image_id, case when c >= r and c > 1 then c - 1 else c end, case when c >= r and c > 1 then r when r > 1 then r - 1 else r end from shrink where c * r > 64 and (c > 1 or r > 1)),
fit as (select s.*, k.c, k.r, ceil(w / k.c::double)::int cw, ceil(h / k.r::double)::int ch from sized s join (select image_id, c, r from shrink where c * r <= 64 or (c = 1 and r = 1)) k using (image_id)),
boxes as (select *, col * cw core_x0, least(w, (col + 1) * cw) core_x1, row_ * ch core_y0, least(h, (row_ + 1) * ch) core_y1 from (select *, unnest(range(c)) col from (select *, unnest(range(r)) row_ from fit))),
read_ as (select *, greatest(0, core_x0 - 96) read_x0, least(w, core_x1 + 96) read_x1, greatest(0, core_y0 - 96) read_y0, least(h, core_y1 + 96) read_y1 from boxes where core_x0 < core_x1 and core_y0 < core_y1),
at_ as (select *, x + floor(read_x0 * downsample + 0.5::double)::bigint full_x, y + floor(read_y0 * downsample + 0.5::double)::bigint full_y from read_),
full_ as (select *, least(image_width - full_x, floor((read_x1 - read_x0) * downsample + 0.5::double)::bigint) full_w, least(image_height - full_y, floor((read_y1 - read_y0) * downsample + 0.5::double)::bigint) full_h from at_),
tiles as (select *, row_number() over (partition by image_id order by row_, col) - 1 tile_id from full_ where full_w > 0 and full_h > 0),
full_tiles as (select * from tiles)"""
BOX = ["core_x0", "core_x1", "core_y0", "core_y1", "read_x0", "read_x1", "read_y0", "read_y1"]


def make_tiles(spark, d):
    return tiles.make_tiles(regions(spark, d)).select("image_id", *longs("tile_id", *BOX, "full_x", "full_y", "full_w", "full_h"))


def tile_name(spark, d):
    t = tiles.make_tiles(regions(spark, d)).join(regions(spark, d).select("image_id", "downsample"), "image_id")
    return tiles.tile_name(t, F.col("downsample"), F.lit("0")).select("image_id", *longs("tile_id"), "file_name")


def pick_tile(spark, d):
    r = regions(spark, d)
    points = r.select("image_id", F.explode(F.array(F.lit(0.3), F.lit(0.9), F.lit(1.5))).alias("q"), "width", "height", "downsample").select("image_id", (F.col("q") * F.col("width") / F.col("downsample")).alias("px"), (F.col("q") * F.col("height") / F.col("downsample")).alias("py"))
    out = tiles.pick_tile(tiles.make_tiles(r), points)
    return out.select("image_id", R(F.col("px")).alias("px"), R(F.col("py")).alias("py"), *longs("tile_id"))


def assign_tiles(spark, d):
    p = fx.px_multi(spark, d).withColumn("y", F.col("y").cast("int"))
    r = p.groupBy("image_id").agg(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(128).alias("width"), F.lit(128).alias("height"), F.lit(1.0).alias("downsample"))
    return tiles.assign_tiles(p, tiles.make_tiles(r, core=48, overlap=8)).select("image_id", *longs("channel", "x", "y", "tile_id"))


_DENSE = "one as (select image_id, x, y, g, t from gray where channel = 0), grid as (select image_id, xx::int x, yy::bigint y from (select distinct image_id from one), range(128) a(xx), range(128) b(yy)), dense as (select gr.image_id, gr.x, gr.y, coalesce(o.g, 0) g, coalesce(case when o.g > o.t then 1 else 0 end, 0) f from grid gr left join one o using (image_id, x, y))"
_MASK = "mask as (select image_id, x, y, not (f = 1 and (x + y) % 3 = 0) inside from dense), dist as (select a.image_id, a.x, a.y, case when a.inside then (select min(abs(a.x - b.x) + abs(a.y - b.y)) from mask b where b.image_id = a.image_id and not b.inside) else 0 end distance from mask a)"
#: Edge pixels of the images in a table dense_px (image_id, x, y, g) of 96 x 96 pixels: gradient ridges, then everything that is joined to a strong one.
EDGES = """taps(dx, dy, wx, wy) as (values (-1, -1, -1, -1), (0, -1, 0, -2), (1, -1, 1, -1), (-1, 0, -2, 0), (1, 0, 2, 0), (-1, 1, -1, 1), (0, 1, 0, 2), (1, 1, 1, 1)),
grad as (select c.image_id, c.x, c.y, sum(n.g * wx) gx, sum(n.g * wy) gy from dense_px c, taps, dense_px n where n.image_id = c.image_id and n.x = c.x + dx and n.y = c.y + dy and c.x between 1 and 94 and c.y between 1 and 94 group by c.image_id, c.x, c.y),
mag as (select *, abs(gx) + abs(gy) m, case when abs(gy) * 1000 < abs(gx) * 414 then 1 when abs(gy) * 1000 > abs(gx) * 2414 then 0 else 1 end sx, case when abs(gy) * 1000 < abs(gx) * 414 then 0 when abs(gy) * 1000 > abs(gx) * 2414 then 1 when (gx >= 0) = (gy >= 0) then 1 else -1 end sy from grad),
ridge as (select a.image_id, a.x, a.y, a.m from mag a left join mag p on p.image_id = a.image_id and p.x = a.x - a.sx and p.y = a.y - a.sy left join mag q on q.image_id = a.image_id and q.x = a.x + a.sx and q.y = a.y + a.sy where a.m > 40 and coalesce(p.m < a.m, true) and coalesce(q.m <= a.m, true)),
points as (select image_id, x, y from ridge where m > 120 union select e.image_id, e.x, e.y from points k, taps, ridge e where e.image_id = k.image_id and e.x = k.x + dx and e.y = k.y + dy)"""
#: Lines with the most votes of their surroundings, and the segments along them.
VOTES = "spread as (select image_id, x, y, theta, floor(floor((x * cos(radians(theta)) + y * sin(radians(theta))) * 1000000000.0::double + 0.5::double) / 1000000000.0::double + 0.5::double)::bigint rho from points, range(180) t(theta)), votes as (select image_id, theta, rho, count(*) votes from spread group by all having count(*) >= {least}), peaks as (select image_id, theta, rho, votes from votes v where not exists (select 1 from votes u where u.image_id = v.image_id and abs(u.theta - v.theta) <= 1 and abs(u.rho - v.rho) <= 1 and (u.votes, -u.theta, -u.rho) > (v.votes, -v.theta, -v.rho)))"
SEGMENTS = """line as (select *, floor((y * cos(radians(theta)) - x * sin(radians(theta))) * 1000000000.0::double + 0.5::double) / 1000000000.0::double t from spread join peaks using (image_id, theta, rho)),
gaps as (select *, case when t - lag(t) over w > 5 then 1 else 0 end n from line window w as (partition by image_id, theta, rho order by t, x, y)), parts as (select *, sum(n) over (partition by image_id, theta, rho order by t, x, y rows unbounded preceding) part from gaps),
segs as (select image_id, theta, rho, votes, part, first({{'x': x, 'y': y}} order by t, x, y) a, last({{'x': x, 'y': y}} order by t, x, y) b, count(*) pixels from parts group by image_id, theta, rho, votes, part), long as (select *, sqrt(((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))::double) length from segs),
ranked as (select *, row_number() over (partition by image_id order by length desc, theta, rho, part) - 1 seg_id from long where length >= 15)"""


def lines_sql(dense: str = "select image_id, x, y, g from gray", least: int = 30, tail: str = "") -> str:
    """Everything up to the table `ranked` of segments, on the grey images that `dense` selects."""
    return f"{gray_sql('px_lines')},\ndense_px as ({dense}),\n{EDGES},\n{VOTES.format(least=least)},\n{SEGMENTS.format()} {tail}".replace("with ", "with recursive ", 1)


_TURN = "degrees(atan2(-(b.y - a.y), b.x - a.x))"

QUERIES = {
    "px_scan": (px_scan, f"{fx.with_tables('px_scan')} select image_id, channel::bigint channel, x::bigint x, y, {r6('value')} as value from px_scan"),
    "foreground_share": (foreground_share, f"{gray_sql('px_multi')} select image_id, channel::bigint channel, count(*) n, {r6('min(norm_lo)')} norm_lo, {r6('max(norm_hi)')} norm_hi, max(t) t, {r6('avg(case when g > t then 1.0::double else 0 end)')} share from gray group by image_id, channel"),
    "crop": (crop, f"{fx.with_tables('px_scan')} select image_id, channel::bigint channel, x::bigint x, y, {r6('value')} as value from px_scan, (select max(y) my from px_scan) where x >= 3 and x < 24 and y >= floor(my * 0.25::double + 0.2::double) and y < ceil(my * 0.25::double + 0.2::double + my * 0.5::double)"),
    "downsample": (downsample, f"{fx.with_tables('px_multi')} select image_id, channel::bigint channel, floor(x / 2.5::double)::bigint x, floor(y / 2.5::double)::bigint y, {r6("avg(value)")} as value from px_multi group by image_id, channel, floor(x / 2.5::double), floor(y / 2.5::double)"),
    "region_reads": (region_reads, f"{fx.with_tables('px_multi')} select image_id, channel::bigint channel, x::bigint x, y, 1::bigint d, {r6('value')} as value from px_multi where x >= 37 and x < 89 and y >= 20 and y < 88 union all select image_id, channel, x // 4, y // 4, 4, {r6('avg(value)')} from px_multi group by image_id, channel, x // 4, y // 4"),
    "channel_clamp": (channel_clamp, f"{fx.with_tables('px_multi')} select image_id, channel::bigint channel, x::bigint x, y, {r6('value')} as value from px_multi where channel = (select max(channel) from px_multi)"),
    "channel_stats": (channel_stats, f"{fx.with_tables('px_multi', 'px_scan')}, both_px as (select image_id, channel, value from px_multi union all select -1, channel, value from px_scan), {STATS.format(px='both_px')} select image_id::bigint image_id, channel::bigint channel, n::bigint n, {', '.join(f'{r6(c)} {c}' for c in ('lo', 'hi', 'norm_lo', 'norm_hi', 'threshold'))} from stats"),
    "to_gray": (to_gray, f"{gray_sql('px_scan')} select image_id, channel::bigint channel, x::bigint x, y, g from gray"),
    "gray_robust": (gray_robust, f"""{fx.with_tables('px_multi')}, top as (select image_id, channel, max(value) mx from px_multi where value > 0 group by all), hist as (select image_id, channel, mx, least(floor(value * (2048.0::double / mx)), 2047) bin, count(*) c from px_multi join top using (image_id, channel) where value > 0 group by all),
cum as (select *, sum(c) over (partition by image_id, channel order by bin) cu, ceil(sum(c) over (partition by image_id, channel) * 0.995::double) target from hist), white as (select image_id, channel, case when (min(bin) + 1) * (mx / 2048.0::double) > mx * 0.02::double then (min(bin) + 1) * (mx / 2048.0::double) else mx end w from cum where cu >= target group by image_id, channel, mx)
select image_id, channel::bigint channel, x::bigint x, y, coalesce(greatest(0, least(255, floor(value * (255.0::double / w) + 0.5::double))), 0)::bigint g from px_multi left join white using (image_id, channel)"""),
    "gray_max": (gray_max, f"{fx.with_tables('px_multi')} select image_id, channel::bigint channel, x::bigint x, y, {r6('value / (max(value) over (partition by image_id, channel)) * 255.0::double')} as level from px_multi"),
    "threshold_mask": (threshold_mask, f"{gray_sql('px_scan')} select image_id, channel::bigint channel, x::bigint x, y, g from gray where g > t"),
    "fraction_above": (fraction_above, f"{fx.with_tables('px_multi')} select image_id, channel::bigint channel, {r6('avg(case when value > 50000 then 1.0::double else 0 end)')} fraction from px_multi group by image_id, channel"),
    "mask_outside": (mask_outside, f"{gray_sql('px_multi')} select image_id, x::bigint x, y, case when (x - 64) * (x - 64) + (y - 64) * (y - 64) <= 1600 then g else 0 end g, (x - 64) * (x - 64) + (y - 64) * (y - 64) <= 1600 inside from gray where channel = 0"),
    "gaussian_blur": (gaussian_blur, f"{gray_sql('px_multi')}, {_DENSE}, k as (select i, exp(-(i * i) / 2.0::double) / (select sum(exp(-(j * j) / 2.0::double)) from range(-3, 4) q(j)) w from range(-3, 4) p(i)), px as (select image_id, x, y, (select sum(d.g * w) from k join dense d on d.image_id = a.image_id and d.y = a.y and d.x = least(127, greatest(0, a.x + i))) g from dense a), py as (select image_id, x, y, (select sum(d.g * w) from k join px d on d.image_id = a.image_id and d.x = a.x and d.y = least(127, greatest(0, a.y + i))) g from px a) select image_id, x::bigint x, y, floor(round(g, 9) + 0.5::double)::bigint g from py"),
    "distance_transform": (distance_transform, f"{gray_sql('px_multi')}, {_DENSE}, {_MASK} select image_id, x::bigint x, y, distance::bigint distance from dist"),
    "local_maxima": (local_maxima, f"{gray_sql('px_multi')}, {_DENSE}, {_MASK} select image_id, x::bigint x, y, distance::bigint distance from dist a where distance >= 2 and not exists (select 1 from dist b where b.image_id = a.image_id and abs(b.x - a.x) <= 6 and abs(b.y - a.y) <= 6 and (b.distance > a.distance or (b.distance = a.distance and (b.y < a.y or (b.y = a.y and b.x < a.x)))))"),
    "sobel_edges": (sobel_edges, f"""{gray_sql('px_multi')}, {_DENSE}, taps(dx, dy, wx, wy) as (values (-1, -1, -1, -1), (0, -1, 0, -2), (1, -1, 1, -1), (-1, 0, -2, 0), (1, 0, 2, 0), (-1, 1, -1, 1), (0, 1, 0, 2), (1, 1, 1, 1)),
grad as (select c.image_id, c.x, c.y, sum(n.g * wx) gx, sum(n.g * wy) gy from dense c, taps, dense n where n.image_id = c.image_id and n.x = c.x + dx and n.y = c.y + dy and c.x between 1 and 126 and c.y between 1 and 126 group by c.image_id, c.x, c.y),
mag as (select *, abs(gx) + abs(gy) m, case when abs(gy) * 1000 < abs(gx) * 414 then 1 when abs(gy) * 1000 > abs(gx) * 2414 then 0 else 1 end sx, case when abs(gy) * 1000 < abs(gx) * 414 then 0 when abs(gy) * 1000 > abs(gx) * 2414 then 1 when (gx >= 0) = (gy >= 0) then 1 else -1 end sy from grad)
select a.image_id, a.x::bigint x, a.y, a.m::bigint magnitude, a.m > 120 strong from mag a where a.m > 40 and not exists (select 1 from mag b where b.image_id = a.image_id and ((b.x = a.x - a.sx and b.y = a.y - a.sy and b.m >= a.m) or (b.x = a.x + a.sx and b.y = a.y + a.sy and b.m > a.m)))"""),
    "edge_hysteresis": (edge_hysteresis, lines_sql(tail="select image_id, x::bigint x, y::bigint y from points")),
    "hough_votes": (hough_votes, lines_sql(tail="select image_id, theta::bigint theta, rho, votes from peaks")),
    "hough_segments": (hough_segments, lines_sql(tail=f"""select image_id, seg_id, theta::bigint theta, rho, votes, pixels, a.x::bigint ax, a.y::bigint ay, b.x::bigint bx, b.y::bigint "by", {r6('length')} length from ranked where seg_id < 500""")),
    "detect": (detect_lines, lines_sql(tail=f"""select image_id, seg_id fiber_id, a.x::double x0, a.y::double y0, b.x::double x1, b.y::double y1, {r6(f'case when {_TURN} < 0 then ({_TURN} + 180) % 180 else {_TURN} % 180 end + 0.0::double')} angle, {r6('length')} length_arc from ranked where seg_id < 500""")),
    "retry_dense": (retry_dense, f"{gray_sql('px_multi')}, steps as (select * from (values (1, 100.0::double, 2.0::double), (2, 145.0::double, 4.0::double), (3, 208.0::double, 8.0::double), (4, 254.0::double, 16.0::double)) v(k, th, sp)), n as (select image_id, channel, k, th, sp, count(*) filter (where g > th) c from gray, steps group by all), fit as (select image_id, channel, coalesce(min(k) filter (where c <= 4000), 4) k, count(*) filter (where c <= 4000) > 0 ok from n group by all) select image_id, channel::bigint channel, c foreground, k::bigint attempts, {r6('th')} threshold, {r6('sp')} spacing, k > 1 or not ok raised, ok from fit join n using (image_id, channel, k)"),
    "make_tiles": (make_tiles, f"with recursive {REGIONS}, {TILES} select image_id, tile_id, {', '.join(f'{c}::bigint {c}' for c in BOX)}, full_x, full_y, full_w, full_h from full_tiles"),
    "tile_name": (tile_name, f"with recursive {REGIONS}, {TILES} select image_id, tile_id, 'fiberlake_tile_x' || full_x || '_y' || full_y || '_w' || (read_x1 - read_x0) || '_h' || (read_y1 - read_y0) || '_ds' || case when downsample = floor(downsample) then downsample::int::varchar else replace(downsample::varchar, '.', 'p') end || '_ch0.parquet' file_name from full_tiles"),
    "pick_tile": (pick_tile, f"with recursive {REGIONS}, {TILES}, pts as (select image_id, q * width / downsample px, q * height / downsample py from regions, (values (0.3::double), (0.9::double), (1.5::double)) v(q)) select image_id, {r6('px')} px, {r6('py')} py, coalesce((select min(tile_id) from tiles t where t.image_id = p.image_id and px >= core_x0 and px < core_x1 and py >= core_y0 and py < core_y1), (select count(*) // 2 from tiles t where t.image_id = p.image_id)) tile_id from pts p"),
    "assign_tiles": (assign_tiles, f"{fx.with_tables('px_multi')}, t as (select r * 3 + c tile_id, c * 43 - 8 x0, least(128, (c + 1) * 43) + 8 x1, r * 43 - 8 y0, least(128, (r + 1) * 43) + 8 y1 from range(3) a(c), range(3) b(r)) select image_id, channel::bigint channel, x::bigint x, y, tile_id from px_multi, t where x >= x0 and x < x1 and y >= y0 and y < y1"),
}
