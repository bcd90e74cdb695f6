"""Queries on fibres, outlines, seams, tuning and streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberlake.functions import geometry as g
from fiberlake.functions import params
from fiberlake.operators import boundary, detect, fibers, pipeline, pixels, rounds, seams, tiles, tracing, tuning
from fiberlake.plans import pixel_queries
from fiberlake.plans.pixel_queries import GRAY, REGIONS, STATS, gray_lines, gray_of, line_columns, lines_sql, longs, r6, regions
from fiberlake.sources import fixtures as fx
from fiberlake.sources.pixels import fibers_from_json, fibers_to_json, read_annotations, read_truth_lines
from fiberlake.streaming import streams

R = g.rounded
KEYS = ["image_id", "tile_id", "fiber_id"]
MEASURED = fx.with_tables("measured")


def traced(spark, d) -> DataFrame:
    """Measured fibres with widths, some of them unknown."""
    f = fibers.measured(fx.raw_fibers(spark, d))
    width = F.when(F.size("points") % 4 == 3, None).otherwise(2.0 + F.col("fiber_id") % 60)
    return f.withColumn("width", width).withColumn("tacs", F.lit(None).cast("string"))


def polyline_metrics(spark, d):
    return traced(spark, d).select(*KEYS, *[R(F.col(c)).alias(c.removeprefix("center.")) for c in ("length_arc", "length_end", "angle", "straightness", "center.x", "center.y")])


def segment_from_center(spark, d):
    f = traced(spark, d)
    s = f.select(*KEYS, g.segment_from_center(F.col("center"), F.col("angle"), F.col("length_arc")).alias("s"))
    return s.select(*KEYS, *[R(F.col("s")[i][c]).alias(f"{c}{i}") for i in (0, 1) for c in "xy"])


def frames(spark, d):
    f = traced(spark, d).join(regions(spark, d).select("image_id", F.col("x").alias("ox"), F.col("y").alias("oy"), "downsample"), "image_id")
    full = g.to_full(g.moved(F.col("points"), 10.0, -5.0), F.col("ox"), F.col("oy"), F.col("downsample"))
    both = f.select(*KEYS, full.alias("full"), g.to_local(full, F.col("ox"), F.col("oy"), F.lit(2.0)).alias("local"))
    return both.select(*KEYS, F.posexplode(F.arrays_zip("full", "local")).alias("pos", "p")).select(*KEYS, *longs("pos"), R(F.col("p.full.x")).alias("fx"), R(F.col("p.full.y")).alias("fy"), R(F.col("p.local.x")).alias("lx"), R(F.col("p.local.y")).alias("ly"))


def length_width_filter(spark, d):
    f = fibers.filter_max_width(fibers.filter_min_length(traced(spark, d), 30.0), 40.0)
    return f.select(*KEYS, R(F.col("length_arc")).alias("length_arc"), F.col("width"))


def filter_counts(spark, d):
    return fibers.filter_counts(traced(spark, d), 30.0, 40.0).select("image_id", "tile_id", *longs("n_traced", "n_after_length", "n_length_dropped", "n_width_dropped"))


def in_bounds(spark, d):
    return fibers.in_bounds(traced(spark, d), 256, 200).select(*KEYS)


def edge_exclusion(spark, d):
    return fibers.exclude_edge(fibers.filter_vertices(traced(spark, d), 3), 512, 512, 60.0).select(*KEYS)


def renumber(spark, d):
    return fibers.renumber(traced(spark, d)).select(*KEYS, *longs("new_id"))


def tile_orientation(spark, d):
    t = fibers.tile_orientation(traced(spark, d))
    return t.select("image_id", "tile_id", *longs("n"), R(F.col("angle_mean")).alias("angle_mean"), R(F.col("angle_std")).alias("angle_std"), "degenerate")


def core_ownership(spark, d):
    f = traced(spark, d)
    images = f.groupBy("image_id").agg(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(512).alias("width"), F.lit(512).alias("height"), F.lit(1.0).alias("downsample"))
    return tiles.owned_by_core(f, tiles.make_tiles(images, core=256, overlap=32)).select(*KEYS)


def reconstruct(spark, d):
    v = fx.vertices(spark, d)
    line = v.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "vertex_id"))), lambda s: s["vertex_id"]).alias("v"))
    paths = line.select(*KEYS, F.concat("v", F.array(F.lit(-1).cast("long"))).alias("v"), F.filter("v", lambda i: i % 2 == 0).alias("fa_v"))
    out = fibers.reconstruct_polylines(paths, v)
    return out.select(*KEYS, F.size("points").cast("long").alias("n"), R(F.col("width")).alias("width"), R(F.col("center.x")).alias("cx"), R(F.col("length_arc")).alias("length_arc"))


def run_diagnostics(spark, d):
    counts = ["tiles", "failed_tiles", "raised_tiles", "n_traced", "n_length_dropped", "n_width_dropped"]
    return fibers.run_diagnostics(fx.tile_stats(spark, d)).select("image_id", *longs(*counts), "advice")


def unit_convert(spark, d):
    um, ds = F.col("pixel_size_um"), F.col("downsample")
    to = lambda v: params.to_analysed_px(F.lit(v), um, ds)
    return regions(spark, d).select(
        "image_id", params.whole_at_least(1, to(15.0)).alias("min_length"), params.whole_at_least(2, to(16.0)).alias("spacing"), params.whole_at_least(1, to(6.0)).alias("box"), params.whole_at_least(2, to(6.0)).alias("window"),
        R(F.greatest(F.lit(1.0), to(10.0))).alias("gap"), R(to(40.0)).alias("max_width"), R(params.from_analysed_px(to(40.0), um, ds)).alias("back"),
    )


def angle_params(spark, d):
    v = F.col("value")
    return fx.table(spark, d, "events").select("event_id", R(params.bend_to_cos(v)).alias("bend"), R(params.link_to_cos(v)).alias("link"), R(params.cos_to_bend(params.bend_to_cos(v))).alias("bend_back"), R(params.cos_to_link(params.link_to_cos(v))).alias("link_back"), params.native_to_threshold(v, F.lit(10.0), F.lit(90.0)).cast("long").alias("threshold"))


def merge_overrides(spark, d):
    e = fx.table(spark, d, "events")
    text = lambda c: c.cast("string")
    defaults = F.create_map(F.lit("LL1"), F.lit("30"), F.lit("thresh_LMPdist"), F.lit("16"), F.lit("s_xlinkbox"), F.lit("6"))
    override = F.create_map(F.lit("thresh_LMPdist"), text(F.col("event_id") % 40 / 2), F.lit("LL1"), F.when(F.col("event_id") % 3 == 0, None).otherwise(text(F.col("event_id") % 50)))
    extra = F.create_map(F.lit("s_xlinkbox"), F.when(F.col("event_id") % 5 == 0, F.lit("wide")).otherwise(text(F.col("user_id") % 9 / 2)), F.lit("note"), F.col("event_type"))
    m = params.whole_numbers(params.merged(defaults, override, extra))
    return e.select("event_id", F.explode(m).alias("key", "value"))


def fiber_json_roundtrip(spark, d):
    f = traced(spark, d).withColumn("angle_to_tangent", F.lit(None).cast("double")).withColumn("distance_to_boundary", F.lit(None).cast("double"))
    back = fibers_from_json(fibers_to_json(f, ["image_id", "tile_id"]))
    return back.select(*KEYS, F.size("points").cast("long").alias("n"), R(F.col("length_arc")).alias("length_arc"), R(F.col("center.y")).alias("cy"), "width", "tacs")


def _rings(spark, d) -> DataFrame:
    return fx.rings(traced(spark, d))


def _classified(spark, d) -> DataFrame:
    return boundary.classify_tacs(boundary.nearest_boundary(traced(spark, d), _rings(spark, d)))


def nearest_boundary(spark, d):
    return boundary.nearest_boundary(traced(spark, d), _rings(spark, d)).select(*KEYS, R(F.col("distance_to_boundary")).alias("distance"), R(F.col("angle_to_tangent")).alias("angle"))


def nearest_outline(spark, d):
    """Distances beyond the zone as well."""
    f = boundary.nearest_boundary(traced(spark, d), _rings(spark, d), zone=20.0, beyond=True)
    return f.select(*KEYS, R(F.col("distance_to_boundary")).alias("distance"), R(F.col("angle_to_tangent")).alias("angle"))


def classify_tacs(spark, d):
    return _classified(spark, d).select(*KEYS, "tacs")


def tacs_counts(spark, d):
    return fibers.tacs_counts(_classified(spark, d))


def to_objects(spark, d):
    o = fibers.to_objects(_classified(spark, d), regions(spark, d))
    m = F.col("measurements")
    length = F.coalesce(m["Length (um)"], m["Length (px)"])
    return o.select("image_id", "fiber_id", "class", "name", "rgb", R(F.get("points", F.lit(0))["x"]).alias("x0"), F.size(F.map_keys(m)).cast("long").alias("n_measurements"), R(length).alias("length"), m["Length (um)"].isNotNull().alias("calibrated"))


def replace_existing(spark, d):
    f = traced(spark, d)
    old = f.where("fiber_id % 2 = 1").select("image_id", "fiber_id", F.element_at(F.array(*[F.lit(c) for c in ("Fiber", "TACS-1", "TACS-2", "TACS-3", "Other")]), (F.col("fiber_id") % 5 + 1).cast("int")).alias("class"), F.col("center.x").alias("cx"), F.col("center.y").alias("cy"), F.lit("old").alias("origin"))
    new = f.where("fiber_id % 2 = 0").select("image_id", "fiber_id", F.lit("Fiber").alias("class"), F.col("center.x").alias("cx"), F.col("center.y").alias("cy"), F.lit("new").alias("origin"))
    box = f.groupBy("image_id").agg(F.lit(100).alias("x"), F.lit(0).alias("y"), F.lit(200).alias("width"), F.lit(300).alias("height"))
    return fibers.replace_existing(old, new, box).select("image_id", "fiber_id", "class", "origin")


def split_parts(spark, d):
    return boundary.split_parts(fx.rings(traced(spark, d), zero_area=True)).select("image_id", *longs("annotation_id", "part_id"), R(F.col("area")).alias("area"))


def gt_in_piece(spark, d):
    return boundary.lines_in_parts(fx.gt_lines(traced(spark, d)), _rings(spark, d)).select("image_id", "line_id", *longs("annotation_id", "part_id"))


def rasterize_polygon(spark, d):
    box = traced(spark, d).groupBy("image_id").agg(F.lit(180).alias("x"), F.lit(10).alias("y"), F.lit(300).alias("width"), F.lit(120).alias("height"), F.lit(1.5).alias("downsample"))
    return boundary.rasterize_polygon(fx.rings(traced(spark, d), zero_area=True), box).select("image_id", *longs("annotation_id", "x", "y"))


def rasterize_fibers(spark, d):
    p = boundary.rasterize_fibers(traced(spark, d), 512, 512)
    return p.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


def score_unsupervised(spark, d):
    gray = gray_of(fx.px_multi(spark, d)).where("channel = 0 and g > t").select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    covered = boundary.coverage(gray, boundary.rasterize_fibers(traced(spark, d), 128, 128))
    return tuning.score_unsupervised(traced(spark, d), covered, 128, 128).select("image_id", *longs("n"), "score", "coverage", "straightness", "angle_std", "degenerate", "runaway")


def dedup_candidates(spark, d):
    return seams.dedup_candidates(traced(spark, d)).select("image_id", "better", "worse")


def dedup(spark, d):
    return seams.dedup_once(traced(spark, d)).select(*KEYS)


def dedup_rounds(spark, d):
    return seams.dedup_fibers(traced(spark, d)).select(*KEYS)


def stitch_candidates(spark, d):
    return seams.stitch_candidates(traced(spark, d)).select("image_id", "a", *longs("a_end"), "b", *longs("b_end"), R(F.col("gap")).alias("gap"))


def stitch(spark, d):
    return seams.stitch_fibers(traced(spark, d)).select(*KEYS, F.size("points").alias("n"), "length_arc")


def postprocess(spark, d):
    return pipeline.postprocess(traced(spark, d), _rings(spark, d)).select("image_id", "fiber_id", "tacs", "length_arc")


def match_candidates(spark, d):
    f = traced(spark, d)
    c = tuning.match_candidates(f, fx.gt_lines(f))
    return c.select("image_id", "line_id", "fiber_id", R(F.col("dist")).alias("dist"), R(F.col("err")).alias("err"))


def match_gt(spark, d):
    f = traced(spark, d)
    return tuning.match_ground_truth(tuning.match_candidates(f, fx.gt_lines(f))).select("image_id", "line_id", "fiber_id")


def _supervised(spark, d, mode):
    f = traced(spark, d)
    lines = fx.gt_lines(f)
    m = tuning.match_ground_truth(tuning.match_candidates(f, lines))
    return tuning.score_supervised(f, lines, m, mode).select("image_id", *longs("n", "n_gt", "matched"), "score", "recall", "precision", "fbeta", "orient_err", "count_score", "count_ratio", "len_factor")


def score_supervised(spark, d):
    return _supervised(spark, d, "match")


def score_count(spark, d):
    return _supervised(spark, d, "count")


def _scores(spark, d) -> DataFrame:
    """Scores of combos on pieces, from the run statistics."""
    s = fx.tile_stats(spark, d)
    return s.groupBy((F.col("event_id") % 24).alias("combo_key"), F.col("image_id").alias("piece_id")).agg(F.sum("n_width_dropped").alias("n"), F.count(F.lit(1)).alias("n_gt"), F.sum(F.when(F.col("ok"), F.least("n_width_dropped", F.lit(1))).otherwise(0)).alias("matched"), F.max(F.col("n_traced") % 30).cast("double").alias("orient_err"), (F.max("n_length_dropped") % 10 / 10.0).alias("len_factor"))


def pool_pieces(spark, d):
    p = tuning.pool_pieces(_scores(spark, d))
    return p.select("combo_key", *longs("n", "n_gt", "matched"), *[R(F.col(c)).alias(c) for c in ("orient_err", "len_factor", "count_ratio", "recall", "score")])


def _rounds(spark, d) -> DataFrame:
    e = fx.table(spark, d, "events")
    return e.select((F.col("user_id") % 50).cast("string").alias("combo_key"), (F.col("event_id") % 3).cast("int").alias("round"), (F.floor("value") / 100.0).alias("score"))


def best_per_combo(spark, d):
    return tuning.best_per_combo(_rounds(spark, d)).select("combo_key", *longs("round"), R(F.col("score")).alias("score"))


def _ranked(spark, d) -> DataFrame:
    e = fx.table(spark, d, "events").select(F.floor(F.col("user_id") / 15).alias("area_id"), F.col("event_id").alias("combo_id"), (F.floor("value") / 100.0).alias("score"), (F.col("event_id") % 17 + 2).alias("seed"), (F.col("event_id") % 30 / 100.0).alias("sens"), (F.col("event_id") % 89).cast("double").alias("bend"), (F.col("event_id") % 61).cast("double").alias("link"))
    return tuning.rank_combos(e, ["area_id"])


def rank_combos(spark, d):
    return _ranked(spark, d).select("area_id", "combo_id", R(F.col("score")).alias("score"), *longs("rank"), "in_band", "keeps_fibers")


def top_alternates(spark, d):
    return fibers.alternates(_ranked(spark, d))


def tuning_row(spark, d):
    r = _ranked(spark, d)
    best = r.where("rank = 1").select("area_id", F.concat(F.lit("img\t"), "area_id").alias("image"), F.lit("roi").alias("annotation"), (F.col("combo_id") % 4 + 1).alias("n_pieces"), F.lit(512).alias("region_w"), F.lit(512).alias("region_h"), (F.col("combo_id") * 10).alias("in_roi_px"), F.lit(7).alias("n_gt"), "seed", "sens", "bend", "link", (F.col("combo_id") % 9).alias("n_detected"), (F.col("combo_id") % 9 / 7.0).alias("count_ratio"), "in_band", F.col("sens").alias("len_factor"), (F.col("bend") / 7).alias("orient_err"), "score")
    return fibers.tuning_rows(best, r)


def estimate_runs(spark, d):
    pieces = regions(spark, d).select("image_id", F.explode(F.sequence(F.lit(0), F.col("x") % 20)).alias("piece_id"), F.col("width").alias("pw"), F.col("height").alias("ph"), F.col("downsample").alias("search_down"))
    return tuning.estimate_runs(pieces, 320, 3).select("image_id", *longs("pieces", "largest", "runs"), "verdict")


def _grid(spark, d) -> DataFrame:
    e = fx.table(spark, d, "events").groupBy(F.floor(F.col("user_id") / 15).alias("image_id")).agg(F.max("event_id").alias("m"), F.max("value").alias("v"))
    dbl = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    return e.select("image_id", F.concat(dbl(2, 4, 8, 16), F.array((F.col("m") % 20 + 2).cast("double"))).alias("seed"), F.concat(dbl(0.05, 0.15, 0.30), F.array(F.col("v") % 1)).alias("sensitivity"), dbl(45, 65, 85).alias("bend"), F.concat(dbl(15, 35), F.array((F.col("m") % 3 * 10 + 15).cast("double"))).alias("link"))


def uniq_values(spark, d):
    u = _grid(spark, d).select("image_id", *[tuning.unique_values(F.col(a)).alias(a) for a in ("seed", "sensitivity", "link")])
    return u.select("image_id", F.posexplode("sensitivity").alias("pos", "sensitivity"), F.size("seed").cast("long").alias("n_seed"), F.size("link").cast("long").alias("n_link")).select("image_id", *longs("pos"), R(F.col("sensitivity"), 3).alias("sensitivity"), "n_seed", "n_link")


AXES = ["seed", "sensitivity", "bend", "link"]


def param_grid(spark, d):
    u = _grid(spark, d).select("image_id", *[tuning.unique_values(F.col(a)).alias(a) for a in AXES])
    return tuning.param_grid(u, AXES, 60, ["image_id"]).select("image_id", "combo_id", *[R(F.col(a), 3).alias(a) for a in AXES])


def refine_grid(spark, d):
    best = _grid(spark, d).select("image_id", *[F.element_at(a, -1).alias(a) for a in AXES])
    out = tuning.refine_grid(best, 1)
    return out.select("image_id", *[F.array_join(F.transform(a, lambda v: F.floor(v * 1000 + 0.5).cast("string")), ",").alias(a) for a in AXES])


LEVELS = (20.0, 90.0, 255.0)


def _sweep(gray, combos):
    """Lines of every image and combo: what is not above the combo's level is background."""
    return tuning.sweep_lines(gray, ["image_id"], combos, least=20)


def sweep(spark, d):
    combos = tuning.param_grid(spark.range(1).select(F.array(*map(F.lit, LEVELS)).alias("level")), ["level"])
    f = _sweep(gray_lines(spark, d), combos)
    return f.groupBy("image_id", "combo_id").agg(F.count(F.lit(1)).alias("n"), R(F.max("length_arc")).alias("longest"))


_TILE_ROWS = """select image_id * 10 + tile image_id, x - x0 x, y - y0 y, case when g > th then g else 0 end g from cut_px join runs using (image_id, tile) where ok"""
_RUNS = """gray_px as (select image_id, x, y, g from gray), tile_boxes(tile, x0, y0) as (values (0, 0, 0), (1, 32, 0), (2, 0, 32), (3, 32, 32)),
cut_px as (select * from gray_px, tile_boxes where x >= x0 and x < x0 + 64 and y >= y0 and y < y0 + 64),
levels(k, th, sp) as (values (1, 60.0::double, 2.0::double), (2, 89.0::double, 4.0::double), (3, 129.6::double, 8.0::double), (4, 186.44::double, 16.0::double)),
tried as (select image_id, tile, k, th, sp, count(*) filter (where g > th) c, count(*) px from cut_px, levels group by all),
fits as (select image_id, tile, coalesce(min(k) filter (where c <= 400), 4) k, count(*) filter (where c <= 400) > 0 ok from tried group by all),
runs as (select image_id, tile, th, sp, c, px, k > 1 or not ok raised, ok from fits join tried using (image_id, tile, k))"""
_COUNTED = f"""{lines_sql(_TILE_ROWS, 18).replace("dense_px as (", _RUNS + ", dense_px as (", 1).replace("between 1 and 94", "between 1 and 62")},
counted as (select image_id // 10 image_id, image_id % 10 tile, count(*) n, count(*) filter (where length > 22) long from ranked where seg_id < 500 group by all),
report as (select r.image_id, r.tile tile_id, coalesce(n, 0)::bigint n_traced, coalesce(long, 0)::bigint n_after_length, coalesce(n - long, 0)::bigint n_length_dropped, 0::bigint n_width_dropped, ok, raised seed_auto_raised, 22.0::double min_length_px, sp seed_spacing_used, {r6('round_even(c / px, 4)')} frac_above from runs r left join counted c using (image_id, tile))"""
_SWEEP = f"select image_id * 10 + combo_id image_id, x, y, case when g > level then g else 0 end g from gray, (values {', '.join(f'({i}, {v}::double)' for i, v in enumerate(LEVELS))}) c(combo_id, level)"


def suggest(spark, d):
    """Every image is a piece with its truth lines; each combo's lines are matched with them, scored, and pooled over the pieces."""
    gray = gray_lines(spark, d)
    truth = fx.truth_lines(spark, d)
    images = rounds.written(truth.select("image_id").distinct())
    keys = ["image_id", "combo_id"]

    def score_round(combos):
        # the sensitivity axis drives the level; combos of one level share a detection
        found = rounds.written(tuning.combo_fibers(gray, ["image_id"], combos.withColumn("level", 255.0 * (1 - F.col("sensitivity"))), least=20))
        matched = tuning.match_ground_truth(tuning.match_candidates(found, truth, keys=keys), keys)
        every = tuning.sweep(images, combos.select("combo_id"), lambda x: x)
        s = tuning.score_supervised(found, truth, matched, "count", keys=keys, scored=every)
        pooled = tuning.pool_pieces(s.withColumnRenamed("combo_id", "combo_key").withColumnRenamed("image_id", "piece_id"))
        return pooled.select(F.col("combo_key").alias("combo_id"), F.bround("score", 4).alias("score"))

    found = tuning.suggest(spark, score_round, {"seed": [2, 8], "sensitivity": [0.001, 0.3, 0.9], "bend": [65], "link": [35]}, rounds=2)
    return found.select("combo_key", "round", "score", "rank", "in_band")


def seed_pairs(spark, d):
    seeds = fx.vertices(spark, d).select("image_id", F.col("vertex_id").alias("seed_id"), "x", "y")
    return detect.seed_pairs(seeds, 6.0).select("image_id", "a", "b", "c", R(F.col("dist")).alias("dist"), R(F.col("cosine")).alias("cosine"))


def trace_choice(spark, d):
    """What one round of choosing links, on the vertices as seeds."""
    return tracing.first_choices(tracing.facing_ends(fx.oriented_seeds(spark, d), 9.0, 40.0)).select("image_id", R(F.col("gap")).alias("gap"), *longs("a", "a_end", "b", "b_end"))


def trace_fibers(spark, d):
    """Curved fibres with widths from noisy grey pixels."""
    gray = gray_of(fx.px_curves(spark, d), single=True).select("image_id", "x", "y", "g", F.lit(fx.CURVED).alias("width"), F.lit(fx.CURVED).alias("height"))
    return tracing.trace(gray, F.lit(110), sigma=1.0).select("image_id", "fiber_id", F.size("points").cast("long").alias("n"), *[R(F.col(c)).alias(c) for c in ("width", "length_arc", "length_end", "angle", "straightness")])


def analyse(spark, d):
    p = fx.px_lines(spark, d)
    box = rounds.written(p.groupBy("image_id").agg(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(fx.SIDE).alias("width"), F.lit(fx.SIDE).alias("height"), F.lit(1.0).alias("downsample")))
    return pipeline.analyse(p, box, fx.rings(box), core=48, overlap=16, min_length=15, budget=1_000, least=18).select("image_id", "fiber_id", "tacs", "length_arc")


def _report(spark, d) -> DataFrame:
    p = fx.px_lines(spark, d)
    box = rounds.written(p.groupBy("image_id").agg(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(fx.SIDE).alias("width"), F.lit(fx.SIDE).alias("height"), F.lit(1.0).alias("downsample")))
    return pipeline.analyse_with_report(p, box, None, core=48, overlap=16, threshold=60.0, min_length=22, budget=400, least=18)[1]


def request_stats(spark, d):
    """The counters of each tile of an analysis; dense tiles are eased, those that stay dense fail."""
    return _report(spark, d).select(*longs("image_id", "tile_id", "n_traced", "n_after_length", "n_length_dropped", "n_width_dropped"), "ok", "seed_auto_raised", *[R(F.col(c)).alias(c) for c in ("min_length_px", "seed_spacing_used", "frac_above")])


def run_report(spark, d):
    """What an analysis says of itself."""
    return fibers.run_diagnostics(_report(spark, d)).select("image_id", *longs("tiles", "failed_tiles", "raised_tiles", "n_traced", "n_length_dropped", "n_width_dropped"), R(F.col("min_length_px")).alias("min_length_px"), "advice")


def tile_health(spark, d):
    h = streams.tile_health(fx.tile_stats(spark, d))
    return h.select(F.unix_micros("window_start").alias("window_us"), *longs("tiles", "failed"), R(F.col("mean_traced")).alias("mean_traced"), R(F.col("std_traced")).alias("std_traced"))


def _folder(spark) -> str:
    rounds.cut(spark.range(1))  # makes sure that there is a shared folder
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def annotations(spark, d):
    """Outlines and hand-traced lines written as GeoJSON features, one a line, and read again: a row a vertex."""
    path = _folder(spark)
    pairs = lambda p: F.transform(p, lambda v: F.array(v["x"], v["y"]))
    feature = lambda kind, name, coordinates: F.to_json(F.struct("image_id", "id", F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(F.struct(F.lit("Region").alias("name")).alias("classification"), F.lit(name).alias("name")).alias("properties"))).alias("value")
    parts = _rings(spark, d).groupBy("image_id", F.col("annotation_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("part_id", F.array(pairs("vertices")).alias("v")))).alias("p"))
    outlines = parts.select(feature("MultiPolygon", "outline", F.transform("p", lambda x: x["v"])))
    lines = fx.gt_lines(fx.raw_fibers(spark, d)).withColumn("id", F.col("line_id").cast("int")).select(feature("LineString", "truth", pairs("points")))
    outlines.union(lines).write.text(path)
    rings = read_annotations(spark, path).select("image_id", "name", F.col("annotation_id").cast("long").alias("item"), F.col("part_id").cast("long").alias("part_id"), F.posexplode("vertices").alias("at", "v"))
    truth = read_truth_lines(spark, path).select("image_id", "name", F.col("line_id").alias("item"), F.lit(0).cast("long").alias("part_id"), F.posexplode("points").alias("at", "v"))
    return rings.union(truth).select("image_id", "name", "item", "part_id", *longs("at"), R(F.col("v.x")).alias("x"), R(F.col("v.y")).alias("y"))


def stream_detect(spark, d):
    """Tiles arrive over several batches; a third of them come half read at first and whole later."""
    top = _folder(spark)
    gray = gray_lines(spark, d).select("image_id", F.lit(0).alias("tile_id"), "x", "y", "g", "width", "height")
    find = lambda df: detect.detect(df, ["image_id", "tile_id"])

    def arrive(rows: DataFrame) -> None:
        rows.repartition(4, "image_id").write.mode("append").parquet(f"{top}/in")
        streams.stream_detect(spark, f"{top}/in", gray.schema, f"{top}/tiles", f"{top}/state", find, fibers.renumber, f"{top}/images", files=2).awaitTermination()

    arrive(gray.where("image_id % 3 = 0").withColumn("g", F.when(F.col("x") < 48, F.col("g")).otherwise(0)))
    arrive(gray)
    f = streams.stored(spark, f"{top}/images").drop("fiber_id").withColumnRenamed("new_id", "fiber_id")
    return line_columns(f)


def _streamed(spark, d, transform) -> DataFrame:
    """The final table of a streaming aggregation over the events' files."""
    schema = fx.table(spark, d, "events").schema
    top = _folder(spark)
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 4).parquet(f"{d}/events*.parquet")
    query = transform(rows).writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{top}/out")).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{top}/out")


def _as_stats(events: DataFrame) -> DataFrame:
    return events.select((F.col("event_type") != "error").alias("ok"), F.floor("value").cast("int").alias("n_traced"), F.col("ts").cast("timestamp").alias("event_time"))


def stream_equals_batch(spark, d):
    h = _streamed(spark, d, lambda e: streams.tile_health(_as_stats(e)))
    return h.select(F.unix_micros("window_start").alias("window_us"), *longs("tiles", "failed"), R(F.col("mean_traced")).alias("mean_traced"), R(F.col("std_traced")).alias("std_traced"))


def latest_wins(spark, d):
    out = _streamed(spark, d, lambda e: streams.latest_request_wins(e.select(F.col("user_id").alias("region_id"), F.col("event_id").alias("generation"), F.col("event_type").alias("request"))))
    return out.select("region_id", "generation", "request")


_SEG = """seg as (select image_id, annotation_id, part_id, i - 1 seg, vertices[i].x ax, vertices[i].y ay, vertices[i % len(vertices) + 1].x bx, vertices[i % len(vertices) + 1].y "by" from (select *, unnest(range(1, len(vertices) + 1)) i from rings)),
tseg as (select *, degrees(atan2(-("by" - ay), bx - ax)) a0 from seg where ax <> bx or ay <> "by"), segs as (select *, (a0 + 180) % 180 + 0.0::double tangent from tseg)"""
_ACUTE = "least((({a} - {b}) % 180 + 180) % 180, 180 - (({a} - {b}) % 180 + 180) % 180)"
_NEAR = f"""{fx.with_tables('measured', 'rings')}, {_SEG},
pd as (select image_id, tile_id, fiber_id, angle, straightness, tangent, annotation_id, part_id, seg, center.x x, center.y y, ax, ay, bx - ax dx, "by" - ay dy, greatest(0, least(1, ((center.x - ax) * (bx - ax) + (center.y - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) t from fibers join segs using (image_id)),
dd as (select *, sqrt((ax + t * dx - x) * (ax + t * dx - x) + (ay + t * dy - y) * (ay + t * dy - y)) dist from pd), best as (select *, row_number() over (partition by image_id, tile_id, fiber_id order by dist, annotation_id, part_id, seg) r from dd where dist <= 100),
near as (select f.image_id, f.tile_id, f.fiber_id, f.points, f.length_arc, f.width, b.dist, {_ACUTE.format(a='b.angle', b='b.tangent')} ang, f.straightness, case when b.dist is null then null when {_ACUTE.format(a='b.angle', b='b.tangent')} >= 60 and f.straightness >= 0.8 then 'TACS-3' when {_ACUTE.format(a='b.angle', b='b.tangent')} <= 30 and f.straightness >= 0.8 then 'TACS-2' else 'TACS-1' end tacs from fibers f left join best b on b.r = 1 and b.image_id = f.image_id and b.tile_id = f.tile_id and b.fiber_id = f.fiber_id)"""
_DEDUP = f"""{MEASURED}, pairs as (select a.image_id, a.fiber_id better, b.fiber_id worse from fibers a join fibers b on a.image_id = b.image_id and a.tile_id <> b.tile_id and a.fiber_id <> b.fiber_id and (a.length_arc > b.length_arc or (a.length_arc = b.length_arc and a.fiber_id < b.fiber_id))
where sqrt((b.center.x - a.center.x) * (b.center.x - a.center.x) + (b.center.y - a.center.y) * (b.center.y - a.center.y)) <= 4 and {_ACUTE.format(a='a.angle', b='b.angle')} <= 20 and a.length_arc > 0 and b.length_arc / a.length_arc >= 0.5)"""
_CAND = f"""{fx.with_tables('measured', 'gt')}, truth as (select image_id, line_id, (points[1].x + points[-1].x) / 2 mx, (points[1].y + points[-1].y) / 2 my, (degrees(atan2(-(points[-1].y - points[1].y), points[-1].x - points[1].x)) + 180) % 180 + 0.0::double line_angle, sqrt((points[-1].x - points[1].x) * (points[-1].x - points[1].x) + (points[-1].y - points[1].y) * (points[-1].y - points[1].y)) line_length from gt_lines),
cand as (select image_id, line_id, fiber_id, sqrt((t.mx - f.center.x) * (t.mx - f.center.x) + (t.my - f.center.y) * (t.my - f.center.y)) dist, {_ACUTE.format(a='f.angle', b='t.line_angle')} err from fibers f join truth t using (image_id) where sqrt((t.mx - f.center.x) * (t.mx - f.center.x) + (t.my - f.center.y) * (t.my - f.center.y)) <= 12 and {_ACUTE.format(a='f.angle', b='t.line_angle')} <= 20)"""
# lines one by one, each taking its nearest unused fibre
_GREEDY = f"""{_CAND.replace('with ', 'with recursive ', 1)}, lists as (select image_id, line_id, row_number() over (partition by image_id order by line_id) k, list({{'f': fiber_id, 'e': err}} order by dist, fiber_id desc) c from cand group by image_id, line_id),
walk as (select image_id, 0::bigint k, 0::bigint line_id, null::bigint fiber_id, null::double err, []::bigint[] used from lists group by image_id
 union all select l.image_id, l.k, l.line_id, p.f, p.e, case when p.f is null then used else list_append(used, p.f) end from (select w.image_id, w.used, l.k, l.line_id, [x for x in l.c if not list_contains(w.used, x.f)][1] p from walk w join lists l on l.image_id = w.image_id and l.k = w.k + 1) l),
matches as (select image_id, line_id, fiber_id, err from walk where fiber_id is not null)"""


def _supervised_sql(mode: str) -> str:
    b = lambda e, n: f"(round_even({e}, {n}))"
    score = "fbeta * orient" if mode == "match" else "cs * least(1, recall / 0.5::double) * (0.6::double + 0.25::double * lf + 0.15::double * orient)"
    fbeta = "case when 2.25::double * prec + recall > 0 then 3.25::double * prec * recall / (2.25::double * prec + recall) else 0 end" if mode == "match" else "0.0::double"
    return f"""{_GREEDY}, f as (select image_id, count(*) n, quantile_cont(length_arc, 0.5) filter (where length_arc > 0) det from fibers group by image_id), t as (select image_id, count(*) n_gt, quantile_cont(line_length, 0.5) filter (where line_length > 0) gt from truth group by image_id), m as (select image_id, count(*) matched, avg(err) err from matches group by image_id),
a as (select image_id, n, coalesce(n_gt, 0) n_gt, coalesce(matched, 0) matched, coalesce(matched, 0) / greatest(coalesce(n_gt, 0), 1)::double recall, coalesce(matched, 0) / n::double prec, coalesce(err, 90) oe, n / greatest(coalesce(n_gt, 0), 1)::double ratio, abs(det - gt) / gt off from f left join t using (image_id) left join m using (image_id)),
b as (select *, 1 - 0.5::double * (oe / 90) orient, case when abs(ratio - 1) <= 0.15::double then 1 else exp(-((abs(ratio - 1) - 0.15::double) * (abs(ratio - 1) - 0.15::double)) / (2 * 0.35::double * 0.35::double)) end cs, case when off is null then 0 when off <= 0.25::double then 1 else greatest(0, 1 - (off - 0.25::double)) end lf, {fbeta} fbeta from a)
select image_id, n, n_gt, matched, {b(score, 4)} score, {b('recall', 3)} recall, {b('prec', 3)} "precision", {b('fbeta', 3)} fbeta, {b('oe', 1)} orient_err, {b('cs', 4)} count_score, {b('ratio', 3)} count_ratio, {b('lf', 3)} len_factor from b"""


_RANKED = """ranked as (select *, row_number() over (partition by area_id order by score desc, combo_id) rank, score > 0 and score >= 0.95::double * max(score) over (partition by area_id) in_band from (select user_id // 15 area_id, event_id combo_id, floor(value) / 100::double score, event_id % 17 + 2 seed, event_id % 30 / 100::double sens, (event_id % 89)::double bend, (event_id % 61)::double link from events))"""


def _fixed(e: str, n: int) -> str:
    return f"printf('%.{n}f', floor(({e}) * {10**n}::double + 0.5::double) / {10**n}::double)"


_ALT = f"alts as (select area_id, coalesce(nullif(string_agg('seed' || seed || '/sens' || {_fixed('sens', 2)} || '/bend' || {_fixed('bend', 0)} || '/link' || {_fixed('link', 0)} || ':' || {_fixed('score', 2)}, ' ' order by rank) filter (where rank between 2 and 3), ''), '-') alternates from ranked group by area_id)"
_GRID = "grid as (select image_id, [2::double, 4, 8, 16, (m % 20 + 2)::double] seed, [0.05::double, 0.15::double, 0.30::double, v % 1] sensitivity, [45::double, 65, 85] bend, [15::double, 35, (m % 3 * 10 + 15)::double] link from (select user_id // 15 image_id, max(event_id) m, max(value) v from events group by user_id // 15))"


def _uniq(col: str, name: str) -> str:
    """Rows image_id, v, p: distinct values rounded to three places, in order of first occurrence."""
    return f"{name} as (select image_id, v, row_number() over (partition by image_id order by min(i)) - 1 p, count(*) over (partition by image_id) n from (select image_id, floor({col}[i] * 1000 + 0.5::double) / 1000::double v, i from (select *, unnest(range(1, len({col}) + 1)) i from grid)) group by image_id, v)"


_HEALTH = f"select epoch_us(time_bucket(interval '1 hour', ts)) window_us, count(*) tiles, count(*) filter (where event_type = 'error') failed, {r6('avg(floor(value))')} mean_traced, {r6('stddev_pop(floor(value))')} std_traced from events group by 1"
_RASTER = """s as (select image_id, points[i].x ax, points[i].y ay, points[i + 1].x bx, points[i + 1].y "by" from (select *, unnest(range(1, len(points))) i from raw_fibers)),
rows_ as (select *, unnest(range(greatest(ceil(least(ay, "by") - 2.5::double), 0)::bigint, least(floor(greatest(ay, "by") + 2.5::double), {n} - 1)::bigint + 1)) y from s),
cols as (select *, case when abs("by" - ay) < 1e-9 then ax else ax + (greatest(least(ay, "by"), least(greatest(ay, "by"), y - 2.5::double)) - ay) / ("by" - ay) * (bx - ax) end xa, case when abs("by" - ay) < 1e-9 then bx else ax + (greatest(least(ay, "by"), least(greatest(ay, "by"), y + 2.5::double)) - ay) / ("by" - ay) * (bx - ax) end xb from rows_),
cells as (select *, unnest(range(greatest(ceil(least(xa, xb) - 2.5::double), 0)::bigint, least(floor(greatest(xa, xb) + 2.5::double), {n} - 1)::bigint + 1)) x from cols),
inside as (select *, case when (bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay) > 0 then greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) else 0 end t from cells),
fpx as (select distinct image_id, x, y from inside where sqrt((ax + t * (bx - ax) - x) * (ax + t * (bx - ax) - x) + (ay + t * ("by" - ay) - y) * (ay + t * ("by" - ay) - y)) <= 2.5::double)"""
_RINGS3 = fx.SQL["rings"].replace("t(part_id", "t(part_id").replace("(1, ", "(2, [{'x': 10::double, 'y': 10::double}, {'x': 20::double, 'y': 20::double}, {'x': 10::double, 'y': 10::double}]), (1, ")
_WITH3 = f"{fx.with_tables('fibers')}, {_RINGS3}"


def _metric(sql_tail: str) -> str:
    return f"{MEASURED} {sql_tail}"


QUERIES = {
    "polyline_metrics": (polyline_metrics, _metric(f"select image_id, tile_id, fiber_id, {', '.join(f'{r6(c)} {c}' for c in ('length_arc', 'length_end', 'angle', 'straightness'))}, {r6('center.x')} x, {r6('center.y')} y from fibers")),
    "segment_from_center": (segment_from_center, _metric(f"select image_id, tile_id, fiber_id, {r6('center.x - length_arc / 2 * cos(radians(angle))')} x0, {r6('center.y + length_arc / 2 * sin(radians(angle))')} y0, {r6('center.x + length_arc / 2 * cos(radians(angle))')} x1, {r6('center.y - length_arc / 2 * sin(radians(angle))')} y1 from fibers")),
    "frames": (frames, f"{fx.with_tables('fibers')}, {REGIONS}, p as (select f.image_id, tile_id, fiber_id, points, r.x ox, r.y oy, downsample d, unnest(range(1, len(points) + 1)) i from raw_fibers f join regions r on r.image_id = f.image_id), q as (select image_id, tile_id, fiber_id, i - 1 pos, ox, oy, ox + (points[i].x + 10) * d fx, oy + (points[i].y - 5) * d fy from p) select image_id, tile_id, fiber_id, pos, {r6('fx')} fx, {r6('fy')} fy, {r6('(fx - ox) / 2')} lx, {r6('(fy - oy) / 2')} ly from q"),
    "length_width_filter": (length_width_filter, _metric(f"select image_id, tile_id, fiber_id, {r6('length_arc')} length_arc, width from fibers where length_arc > 30 and (width is null or width <= 40)")),
    "filter_counts": (filter_counts, _metric("select image_id, tile_id, count(*) n_traced, count(*) filter (where length_arc > 30) n_after_length, count(*) filter (where length_arc <= 30) n_length_dropped, count(*) filter (where length_arc > 30 and width > 40) n_width_dropped from fibers group by all")),
    "in_bounds": (in_bounds, _metric("select image_id, tile_id, fiber_id from fibers where center.x >= 0 and center.x < 256 and center.y >= 0 and center.y < 200")),
    "edge_exclusion": (edge_exclusion, f"{fx.with_tables('fibers')} select image_id, tile_id, fiber_id from raw_fibers where len(points) >= 3 and not (list_max([p.x for p in points]) < 60 or list_min([p.x for p in points]) >= 452 or list_max([p.y for p in points]) < 60 or list_min([p.y for p in points]) >= 452)"),
    "renumber": (renumber, f"{fx.with_tables('fibers')} select image_id, tile_id, fiber_id, row_number() over (partition by image_id order by tile_id, fiber_id) - 1 new_id from raw_fibers"),
    "tile_orientation": (tile_orientation, _metric(f"select image_id, tile_id, count(*) n, {r6('avg(angle)')} angle_mean, {r6('stddev_pop(angle)')} angle_std, stddev_pop(angle) < 5 and count(*) > 3 degenerate from fibers group by all")),
    "core_ownership": (core_ownership, _metric("select image_id, tile_id, fiber_id from fibers where center.x >= tile_id % 2 * 256 and center.x < tile_id % 2 * 256 + 256 and center.y >= tile_id // 2 * 256 and center.y < tile_id // 2 * 256 + 256")),
    "reconstruct": (reconstruct, f"{MEASURED}, w as (select image_id, tile_id, fiber_id, 2 * avg(radius) width from vertices where vertex_id % 2 = 0 group by all) select f.image_id, f.tile_id, f.fiber_id, len(points) n, {r6('w.width')} width, {r6('center.x')} cx, {r6('length_arc')} length_arc from fibers f left join w on w.image_id = f.image_id and w.tile_id = f.tile_id and w.fiber_id = f.fiber_id"),
    "run_diagnostics": (run_diagnostics, f"""{fx.with_tables('tile_stats')}, a as (select image_id, count(*) tiles, count(*) filter (where not ok) f, coalesce(sum(n_traced) filter (where ok), 0)::bigint t, coalesce(sum(n_length_dropped) filter (where ok), 0)::bigint l, coalesce(sum(n_width_dropped) filter (where ok), 0)::bigint w from tile_stats group by image_id)
select image_id, tiles, f failed_tiles, 0::bigint raised_tiles, t n_traced, l n_length_dropped, w n_width_dropped, concat_ws(' ', case when l > 0 and t > 0 then 'traced ' || t || ', ' || l || ' too short' || case when l >= t * 0.5 then ': lower the minimum length' else '' end || '.' end, case when w > 0 then w || ' too wide.' end, case when f > 0 then f || ' tiles failed: raise threshold, spacing or downsample.' end) advice from a"""),
    "unit_convert": (unit_convert, f"with {REGIONS}, p as (select image_id, coalesce(pixel_size_um, 1) u, downsample d from regions) select image_id, greatest(1, floor(15 / u / d + 0.5::double)::bigint) min_length, greatest(2, floor(16 / u / d + 0.5::double)::bigint) spacing, greatest(1, floor(6 / u / d + 0.5::double)::bigint) box, greatest(2, floor(6 / u / d + 0.5::double)::bigint) \"window\", {r6('greatest(1, 10 / u / d)')} gap, {r6('40 / u / d')} max_width, {r6('40 / u / d * d * u')} back from p"),
    "angle_params": (angle_params, f"with p as (select event_id, value, greatest(0, least(89, value)) c from events) select event_id, {r6('cos(radians(c))')} bend, {r6('-cos(radians(c))')} link, {r6('degrees(acos(least(1, greatest(-1, cos(radians(c))))))')} bend_back, {r6('degrees(acos(least(1, greatest(-1, cos(radians(c))))))')} link_back, greatest(0, least(255, floor((value - 10) / 80 * 255 + 0.5::double)))::bigint threshold from p"),
    "merge_overrides": (merge_overrides, """with v as (select event_id, user_id, event_type, event_id % 40 / 2::double h, user_id % 9 / 2::double b from events)
select event_id, 'LL1' as key, case when event_id % 3 = 0 then '30' else (event_id % 50)::varchar end as value from v union all select event_id, 'thresh_LMPdist', round_even(h, 0)::bigint::varchar from v
union all select event_id, 's_xlinkbox', case when event_id % 5 = 0 then 'wide' else round_even(b, 0)::bigint::varchar end from v union all select event_id, 'note', event_type from v"""),
    "fiber_json_roundtrip": (fiber_json_roundtrip, _metric(f"select image_id, tile_id, fiber_id, len(points) n, {r6('length_arc')} length_arc, {r6('center.y')} cy, width, null::varchar tacs from fibers")),
    "nearest_boundary": (nearest_boundary, f"{_NEAR} select image_id, tile_id, fiber_id, {r6('dist')} distance, {r6('ang')} angle from near"),
    "nearest_outline": (nearest_outline, f"{_NEAR.replace(' where dist <= 100', '')} select image_id, tile_id, fiber_id, {r6('dist')} distance, {r6('ang')} angle from near"),
    "classify_tacs": (classify_tacs, f"{_NEAR} select image_id, tile_id, fiber_id, tacs from near"),
    "tacs_counts": (tacs_counts, f"{_NEAR}, c as (select image_id, coalesce(tacs, 'none') tacs from near) select image_id, coalesce(tacs, 'all') tacs, count(*) n from c group by rollup (image_id, tacs)"),
    "to_objects": (to_objects, f"{_NEAR}, {REGIONS} select n.image_id, fiber_id, coalesce(tacs, 'Fiber') \"class\", coalesce(tacs, 'Fiber') || ' ' || fiber_id \"name\", case tacs when 'TACS-3' then '255,0,0' when 'TACS-2' then '0,220,0' when 'TACS-1' then '0,110,255' end rgb, {r6('r.x + points[1].x * downsample')} x0, 5 + case when n.width is null then 0 else 1 end + case when dist is null then 0 else 2 end n_measurements, {r6('length_arc * (downsample * coalesce(pixel_size_um, 1))')} length, pixel_size_um is not null calibrated from near n join regions r on r.image_id = n.image_id"),
    "replace_existing": (replace_existing, _metric("select image_id, fiber_id, ['Fiber', 'TACS-1', 'TACS-2', 'TACS-3', 'Other'][fiber_id % 5 + 1] \"class\", 'old' origin from fibers where fiber_id % 2 = 1 and not (fiber_id % 5 <> 4 and center.x >= 100 and center.x < 300 and center.y >= 0 and center.y < 300) union all select image_id, fiber_id, 'Fiber', 'new' from fibers where fiber_id % 2 = 0")),
    "split_parts": (split_parts, f"{_WITH3}, a as (select *, abs(list_sum([vertices[i].x * vertices[i % len(vertices) + 1].y - vertices[i % len(vertices) + 1].x * vertices[i].y for i in range(1, len(vertices) + 1)])) / 2 area from rings) select image_id, annotation_id::bigint annotation_id, part_id::bigint part_id, {r6('area')} area from a where area > 0"),
    "gt_in_piece": (gt_in_piece, f"{fx.with_tables('gt', 'rings')}, {_SEG}, c as (select image_id, line_id, list_avg([p.x for p in points]) x, list_avg([p.y for p in points]) y from gt_lines) select c.image_id, line_id, annotation_id::bigint annotation_id, part_id::bigint part_id from c join segs s on s.image_id = c.image_id and (ay > y) <> (\"by\" > y) and x < ax + (y - ay) * (bx - ax) / (\"by\" - ay) group by all having count(*) % 2 = 1"),
    "rasterize_polygon": (rasterize_polygon, f"{_WITH3}, {_SEG}, local as (select image_id, annotation_id, (ax - 180) / 1.5::double ax, (bx - 180) / 1.5::double bx, (ay - 10) / 1.5::double ay, (\"by\" - 10) / 1.5::double \"by\" from segs), px as (select image_id, annotation_id, xx::bigint x, yy::bigint y from (select distinct image_id, annotation_id from local), range(200) a(xx), range(80) b(yy)) select p.image_id, p.annotation_id::bigint annotation_id, p.x, p.y from px p join local l on l.image_id = p.image_id and l.annotation_id = p.annotation_id and (ay > p.y + 0.5::double) <> (\"by\" > p.y + 0.5::double) and p.x + 0.5::double < ax + (p.y + 0.5::double - ay) * (bx - ax) / (\"by\" - ay) group by all having count(*) % 2 = 1"),
    "rasterize_fibers": (rasterize_fibers, f"{fx.with_tables('fibers')}, {_RASTER.format(n=512)} select image_id, count(*) pixels, sum(x)::bigint sum_x, sum(y)::bigint sum_y from fpx group by image_id"),
    "score_unsupervised": (score_unsupervised, f"""{fx.with_tables('px_multi', 'measured')}, {STATS.format(px='px_multi')}, {GRAY.format(px='px_multi')}, {_RASTER.format(n=128)}, fg as (select image_id, x::bigint x, y from gray where channel = 0 and g > t),
cov as (select image_id, count(f.x) / count(*)::double c from (select fg.image_id, fpx.x from fg left join fpx on fpx.image_id = fg.image_id and fpx.x = fg.x and fpx.y = fg.y) f group by image_id), a as (select image_id, count(*) n, quantile_cont(straightness, 0.5) st, stddev_pop(angle) sd from fibers group by image_id),
b as (select *, case when c is null then true else sd < 8 and n > 3 end deg, least(1, greatest(0, n / 20::double - 1)) run from a left join cov using (image_id))
select image_id, n, round_even(case when c is null then -1 else c + 0.4::double * st - case when deg then 0.5::double else 0 end - 0.3::double * run end, 4) score, round_even(coalesce(c, 0), 3) coverage, round_even(st, 3) straightness, round_even(sd, 1) angle_std, deg degenerate, round_even(run, 3) runaway from b"""),
    "dedup_candidates": (dedup_candidates, f"{_DEDUP} select image_id, better, worse from pairs"),
    "dedup": (dedup, f"{_DEDUP} select image_id, tile_id, fiber_id from fibers f where not exists (select 1 from pairs p where p.image_id = f.image_id and p.worse = f.fiber_id)"),
    # fibres that have a better neighbour, one by one from the longest: one goes if any better neighbour of its own stays
    "dedup_rounds": (dedup_rounds, f"""{_DEDUP.replace('with ', 'with recursive ', 1)}, lists as (select p.image_id, f.fiber_id, row_number() over (partition by p.image_id order by any_value(f.length_arc) desc, f.fiber_id) k, list(p.better) better from pairs p join fibers f on f.image_id = p.image_id and f.fiber_id = p.worse group by p.image_id, f.fiber_id),
walk as (select image_id, 0::bigint k, []::bigint[] gone from lists group by image_id union all select w.image_id, l.k, case when list_has_all(w.gone, l.better) then w.gone else list_append(w.gone, l.fiber_id) end from walk w join lists l on l.image_id = w.image_id and l.k = w.k + 1),
dropped as (select image_id, unnest(arg_max(gone, k)) fiber_id from walk group by image_id)
select f.image_id, f.tile_id, f.fiber_id from fibers f left join dropped d on d.image_id = f.image_id and d.fiber_id = f.fiber_id where d.fiber_id is null"""),
    "stitch_candidates": (stitch_candidates, f"""{fx.with_tables('fibers')}, e as (select image_id, tile_id, fiber_id, 0 en, points[1].x x, points[1].y y, points[1].x - points[2].x dx, points[1].y - points[2].y dy from raw_fibers union all select image_id, tile_id, fiber_id, 1, points[-1].x, points[-1].y, points[-1].x - points[-2].x, points[-1].y - points[-2].y from raw_fibers),
u as (select *, case when dx = 0 and dy = 0 then 0 else dx / sqrt(dx * dx + dy * dy) end ux, case when dx = 0 and dy = 0 then 0 else dy / sqrt(dx * dx + dy * dy) end uy from e)
select a.image_id, a.fiber_id a, a.en::bigint a_end, b.fiber_id b, b.en::bigint b_end, {r6('sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))')} gap from u a join u b on a.image_id = b.image_id and a.tile_id <> b.tile_id and a.fiber_id < b.fiber_id where sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 6 and a.ux * b.ux + a.uy * b.uy <= -cos(radians(45.0::double))"""),
    "stitch": (stitch, None),
    "postprocess": (postprocess, None),
    "match_candidates": (match_candidates, f"{_CAND} select image_id, line_id, fiber_id, {r6('dist')} dist, {r6('err')} err from cand"),
    "match_gt": (match_gt, f"{_GREEDY} select image_id, line_id, fiber_id from matches"),
    "score_supervised": (score_supervised, _supervised_sql("match")),
    "score_count": (score_count, _supervised_sql("count")),
    "pool_pieces": (pool_pieces, f"""{fx.with_tables('tile_stats')}, s as (select event_id % 24 combo_key, image_id piece_id, sum(n_width_dropped) n, count(*) n_gt, sum(case when ok then least(n_width_dropped, 1) else 0 end) matched, max(n_traced % 30)::double oe, max(n_length_dropped) % 10 / 10::double lf from tile_stats group by event_id % 24, image_id),
a as (select combo_key, sum(n) n, sum(n_gt) g, sum(matched) m, sum(oe * greatest(1, n)) / sum(greatest(1, n)) oe, sum(lf * greatest(1, n)) / sum(greatest(1, n)) lf from s group by combo_key), b as (select *, n / greatest(g, 1)::double ratio, m / greatest(g, 1)::double recall from a), c as (select *, case when abs(ratio - 1) <= 0.15::double then 1 else exp(-((abs(ratio - 1) - 0.15::double) * (abs(ratio - 1) - 0.15::double)) / (2 * 0.35::double * 0.35::double)) end cs from b)
select combo_key, n::bigint n, g::bigint n_gt, m::bigint matched, {r6('oe')} orient_err, {r6('lf')} len_factor, {r6('ratio')} count_ratio, {r6('recall')} recall, {r6('cs * least(1, recall / 0.5::double) * (0.6::double + 0.25::double * lf + 0.15::double * (1 - 0.5::double * (oe / 90)))')} score from c"""),
    "best_per_combo": (best_per_combo, f"with r as (select (user_id % 50)::varchar combo_key, event_id % 3 \"round\", floor(value) / 100::double score from events), k as (select *, row_number() over (partition by combo_key order by score desc, \"round\") n from r) select combo_key, \"round\", {r6('score')} score from k where n = 1"),
    "rank_combos": (rank_combos, f"with {_RANKED} select area_id, combo_id, {r6('score')} score, rank, in_band, rank <= 3 keeps_fibers from ranked"),
    "top_alternates": (top_alternates, f"with {_RANKED}, {_ALT} select * from alts"),
    "tuning_row": (tuning_row, f"with {_RANKED}, {_ALT} select area_id, 'img ' || area_id image, 'roi' annotation, (combo_id % 4 + 1)::varchar n_pieces, '512' region_w, '512' region_h, (combo_id * 10)::varchar in_roi_px, '7' n_gt, seed::varchar seed, {_fixed('sens', 2)} seed_sens, {_fixed('bend', 0)} bend_deg, {_fixed('link', 0)} link_deg, (combo_id % 9)::varchar n_detected, {_fixed('combo_id % 9 / 7::double', 2)} count_ratio, case when in_band then 'Y' else 'N' end in_band, {_fixed('sens', 2)} len_factor, {_fixed('bend / 7', 1)} orient_err, {_fixed('score', 3)} score, alternates from ranked join alts using (area_id) where rank = 1"),
    "estimate_runs": (estimate_runs, f"with {REGIONS}, a as (select image_id, x % 20 + 1 pieces, (ceil(width / downsample) * ceil(height / downsample))::bigint largest from regions) select image_id, pieces::bigint pieces, largest, (pieces * 320 * 3)::bigint runs, case when pieces > 16 or largest > 1440000 then 'refuse' when pieces * 960 > 400 or pieces > 6 or largest > 490000 then 'warn' else 'run' end verdict from a"),
    "uniq_values": (uniq_values, f"with {_GRID}, {_uniq('seed', 'us')}, {_uniq('sensitivity', 'uv')}, {_uniq('link', 'ul')} select uv.image_id, uv.p pos, uv.v sensitivity, (select max(n) from us where us.image_id = uv.image_id) n_seed, (select max(n) from ul where ul.image_id = uv.image_id) n_link from uv"),
    "param_grid": (param_grid, f"with {_GRID}, {_uniq('seed', 'us')}, {_uniq('sensitivity', 'uv')}, {_uniq('bend', 'ub')}, {_uniq('link', 'ul')}, c as (select us.image_id, ((us.p * uv.n + uv.p) * ub.n + ub.p) * ul.n + ul.p combo_id, us.v seed, uv.v sensitivity, ub.v bend, ul.v link from us join uv using (image_id) join ub using (image_id) join ul using (image_id)) select image_id, combo_id, seed, sensitivity, bend, link from c where combo_id < 60"),
    "refine_grid": (refine_grid, f"""with {_GRID}, b as (select image_id, seed[-1] s, sensitivity[-1] v, bend[-1] b, link[-1] k from grid), st as (select *, greatest(1, floor(s * 0.2::double + 0.5::double)) step from b),
raw as (select image_id, [greatest(2, s - step), s, s + step, greatest(2, floor(s / 2 + 0.5::double))] seed, [greatest(0.02::double, least(0.9::double, v - 0.05::double)), v, greatest(0.02::double, least(0.9::double, v + 0.05::double))] sensitivity, [greatest(5, least(89, b - 9)), b, greatest(5, least(89, b + 9))] bend, [greatest(0, least(89, k - 9)), k, greatest(0, least(89, k + 9))] link from st),
grid2 as (select image_id, {', '.join(f'[floor(x * 1000 + 0.5::double)::bigint for x in {a}] {a}' for a in AXES)} from raw)
select image_id, {', '.join(f"array_to_string([{a}[i] for i in range(1, len({a}) + 1) if list_position({a}, {a}[i]) = i], ',') {a}" for a in AXES)} from grid2"""),
    "sweep": (sweep, lines_sql(_SWEEP, 20, f"select image_id // 10 image_id, image_id % 10 combo_id, count(*) n, {r6('max(length)')} longest from ranked where seg_id < 500 group by image_id")),
    "suggest": (suggest, None),
    "analyse": (analyse, None),
    "request_stats": (request_stats, f"{_COUNTED} select image_id, tile_id::bigint tile_id, n_traced, n_after_length, n_length_dropped, n_width_dropped, ok, seed_auto_raised, min_length_px, seed_spacing_used, frac_above from report"),
    "run_report": (run_report, f"""{_COUNTED}, a as (select image_id, count(*) tiles, count(*) filter (where not ok) f, count(*) filter (where ok and seed_auto_raised) r, coalesce(sum(n_traced) filter (where ok), 0)::bigint t, coalesce(sum(n_length_dropped) filter (where ok), 0)::bigint l, max(min_length_px) filter (where ok) m from report group by image_id)
select image_id, tiles, f failed_tiles, r raised_tiles, t n_traced, l n_length_dropped, 0::bigint n_width_dropped, m min_length_px, concat_ws(' ', case when l > 0 and t > 0 then 'traced ' || t || ', ' || l || ' too short (22 px or less)' || case when l >= t * 0.5 then ': lower the minimum length' else '' end || '.' end, case when r > 0 then r || ' dense tiles coarsened.' end, case when f > 0 then f || ' tiles failed: raise threshold, spacing or downsample.' end) advice from a"""),
    "trace_choice": (trace_choice, f"""{fx.with_tables('vertices')}, seeds as (select image_id, vertex_id id, x, y, cos(radians(vertex_id * 37 % 180)) ux, sin(radians(vertex_id * 37 % 180)) uy from vertices),
met as (select a.image_id, a.id a, b.id b, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) d, ((b.x - a.x) * a.ux + (b.y - a.y) * a.uy) pa, ((b.x - a.x) * b.ux + (b.y - a.y) * b.uy) pb from seeds a join seeds b on a.image_id = b.image_id and a.id < b.id and abs(a.x - b.x) <= 9 and abs(a.y - b.y) <= 9),
turned as (select *, floor(pa / d * 1000000000.0::double + 0.5::double) / 1000000000.0::double ca, floor(pb / d * 1000000000.0::double + 0.5::double) / 1000000000.0::double cb from met where d > 0 and d <= 9),
ends as (select image_id, {r6('d * (3.0::double - abs(ca) - abs(cb))')} gap, a, case when ca >= 0 then 1 else 0 end a_end, b, case when cb >= 0 then 0 else 1 end b_end from turned where abs(ca) >= cos(radians(40)) and abs(cb) >= cos(radians(40))),
sides as (select image_id, a f, a_end e, ends from ends union all select image_id, b, b_end, ends from ends),
best as (select ends from (select *, row_number() over (partition by image_id, f, e order by ends.gap, ends.a, ends.a_end, ends.b, ends.b_end) r from sides) where r = 1 group by ends having count(*) = 2)
select ends.image_id image_id, ends.gap gap, ends.a a, ends.a_end::bigint a_end, ends.b b, ends.b_end::bigint b_end from best"""),
    "trace_fibers": (trace_fibers, None),
    "seed_pairs": (seed_pairs, f"""{fx.with_tables('vertices')}, p as (select a.image_id, a.vertex_id a, b.vertex_id b, a.x ax, a.y ay, b.x bx, b.y "by", sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) dist from vertices a join vertices b on a.image_id = b.image_id and a.vertex_id <> b.vertex_id and sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 6),
t as (select p.image_id, p.a, p.b, q.b c, p.dist, q.dist d2, ((p.bx - p.ax) * (q.bx - p.bx) + (p."by" - p.ay) * (q."by" - p."by")) / (p.dist * q.dist) cosine from p join p q on q.image_id = p.image_id and q.a = p.b and q.b <> p.a where p.dist > 0 and q.dist > 0), r as (select *, row_number() over (partition by image_id, a, b order by d2, c) k from t where cosine >= cos(radians(70.0::double)))
select image_id, a, b, c, {r6('dist')} dist, {r6('cosine')} cosine from r where k = 1"""),
    "annotations": (annotations, f"""{fx.with_tables('gt', 'rings')}, v as (select image_id, 'outline' as name, annotation_id::bigint item, part_id::bigint part_id, unnest(vertices) v, unnest(range(len(vertices))) at_ from rings union all select image_id, 'truth', line_id, 0, unnest(points), unnest(range(len(points))) from gt_lines)
select image_id, name, item, part_id, at_::bigint "at", {r6('v.x')} x, {r6('v.y')} "y" from v"""),
    "stream_detect": (stream_detect, pixel_queries.QUERIES["detect"][1]),
    "tile_health": (tile_health, _HEALTH),
    "stream_equals_batch": (stream_equals_batch, _HEALTH),
    "latest_wins": (latest_wins, "select user_id region_id, max(event_id) generation, arg_max(event_type, event_id) request from events group by user_id"),
}
