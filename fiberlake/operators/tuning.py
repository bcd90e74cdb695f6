"""Parameter search: grids, matching against hand-traced lines, scores, pooling and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiberlake.functions import geometry as g
from fiberlake.operators.detect import detect_settings
from fiberlake.operators.rounds import cut, unsent, written
from fiberlake.operators.seams import joined_by, match_ends, near_pairs, settled, turning_ends

AXES = ("thresh_LMPdist", "thresh_LMP", "thresh_ext", "thresh_linka")


def unique_values(values: Column) -> Column:
    """Rounded to three places, each once, order kept."""
    return F.array_distinct(F.transform(values, lambda v: g.rounded(v, 3)))


def param_grid(grid: DataFrame, axes: list[str], max_combos: int | None = 60, keys: list[str] | None = None) -> DataFrame:
    """All combinations of a row's array columns (or scalars) in order, the last axis fastest, capped: keys, combo_id from 0 and one column an axis."""
    types, keys = dict(grid.dtypes), keys or []
    out = grid.select(*keys, *[F.col(a) if types[a].startswith("array") else F.array(a).alias(a) for a in axes])
    index = F.lit(0).cast("long")
    for a in axes:
        out = out.select(*[c for c in out.columns if c != a], F.size(a).alias(f"_n_{a}"), F.posexplode(a).alias(f"_p_{a}", a))
        index = index * F.col(f"_n_{a}") + F.col(f"_p_{a}")
    out = out.select(*keys, index.alias("combo_id"), *axes)
    return out.where(F.col("combo_id") < max_combos) if max_combos is not None else out


def truth_segments(lines: DataFrame) -> DataFrame:
    """Hand-traced lines as image_id, line_id, mx, my (midpoint of the ends), line_angle, line_length."""
    a, b = g.first_point(F.col("points")), g.last_point(F.col("points"))
    return lines.where(F.size("points") >= 2).select("image_id", "line_id", ((a["x"] + b["x"]) / 2).alias("mx"), ((a["y"] + b["y"]) / 2).alias("my"), g.end_angle(F.col("points")).alias("line_angle"), g.end_length(F.col("points")).alias("line_length"))


def match_candidates(fibers: DataFrame, lines: DataFrame, dist: float = 12.0, angle: float = 20.0, keys: list[str] | None = None) -> DataFrame:
    """image_id, line_id, fiber_id, dist, err for each line and fibre within both tolerances."""
    keys = keys or ["image_id"]
    f = fibers.select(*keys, "fiber_id", "angle", F.col("center.x").alias("cx"), F.col("center.y").alias("cy"))
    p = near_pairs(f, truth_segments(lines), "cx", "cy", "mx", "my", dist, ["image_id"])
    return p.withColumn("err", g.acute_difference(F.col("angle"), F.col("line_angle"))).where(F.col("err") <= angle).select(*keys, "line_id", "fiber_id", "dist", "err")


def match_ground_truth(candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One-to-one matches: lines in order each take the nearest unused fibre, the later fibre of equal ones.

    Lines propose to their best remaining fibre, and a fibre keeps the lowest-numbered line (deferred acceptance); that
    gives the same matching as going through the lines one by one, in a few joins.
    """
    keys = keys or ["image_id"]
    left = written(candidates)
    while True:
        w = Window.partitionBy(*keys, "line_id").orderBy("dist", F.col("fiber_id").desc())
        proposed = left.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        held = Window.partitionBy(*keys, "fiber_id").orderBy("line_id")
        ranked = written(proposed.withColumn("_r", F.row_number().over(held)))
        lost = ranked.where("_r > 1").select(*keys, "line_id", "fiber_id")
        if not lost.limit(1).count():
            return ranked.drop("_r")
        left = written(left.join(unsent(lost), [*keys, "line_id", "fiber_id"], "left_anti"))


def even_round(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def count_closeness(n: Column, truth: Column, tolerance: Column | float, sigma: float = 0.35) -> Column:
    """1 within the tolerance of n / truth = 1, a Gaussian beyond."""
    excess = F.abs(n / F.greatest(truth, F.lit(1)) - 1.0) - tolerance
    return F.when(excess <= 0, F.lit(1.0)).otherwise(F.exp(-(excess * excess) / F.lit(2.0 * sigma * sigma)))


def count_score(close: Column, recall: Column, length: Column, orientation: Column, floor: float = 0.5) -> Column:
    return close * F.least(F.lit(1.0), recall / F.lit(floor)) * (0.6 + 0.25 * length + 0.15 * orientation)


def score_supervised(fibers: DataFrame, lines: DataFrame, matches: DataFrame, mode: str = "match", tolerance: float = 0.15, len_tol: float = 0.25, keys: list[str] | None = None, score: Column | None = None, scored: DataFrame | None = None) -> DataFrame:
    """One row per image (and further keys of the fibres, such as combo_id) with the matching's figures and the score.

    scored: the keys that are to have a row (images x combos), also where nothing was detected; by default those that have fibres.

    mode "match": F-measure (beta 1.5) times orientation; "count": closeness of counts, guarded by recall. `score` may be
    any Column over the figures instead.
    """
    keys = keys or ["image_id"]
    f = fibers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(F.when(F.col("length_arc") > 0, F.col("length_arc")), F.lit(0.5)).alias("det_med"))
    t = truth_segments(lines).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_gt"), F.percentile(F.when(F.col("line_length") > 0, F.col("line_length")), F.lit(0.5)).alias("gt_med"))
    m = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"), F.avg("err").alias("err"))
    f = f if scored is None else scored.select(*keys).distinct().join(f, keys, "left")
    a = f.join(t, "image_id", "left").join(m, keys, "left").fillna(0, ["n", "n_gt", "matched"])
    truth = F.greatest(F.col("n_gt"), F.lit(1))
    a = a.withColumn("recall", F.col("matched") / truth).withColumn("precision", F.when(F.col("n") > 0, F.col("matched") / F.col("n")).otherwise(0.0)).withColumn("orient_err", F.coalesce("err", F.lit(90.0)))
    a = a.withColumn("orient_factor", 1.0 - 0.5 * (F.col("orient_err") / 90.0)).withColumn("count_ratio", F.col("n") / truth).withColumn("count_score", count_closeness(F.col("n"), F.col("n_gt"), tolerance))
    off = F.abs(F.col("det_med") - F.col("gt_med")) / F.col("gt_med")
    a = a.withColumn("len_factor", F.when(off.isNull(), F.lit(0.0)).when(off <= len_tol, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - (off - len_tol))))
    weighed = 2.25 * F.col("precision") + F.col("recall")
    fbeta = F.when(weighed > 0, 3.25 * F.col("precision") * F.col("recall") / weighed).otherwise(0.0) if mode == "match" else F.lit(0.0)
    a = a.withColumn("fbeta", fbeta)
    if score is None:
        score = F.col("fbeta") * F.col("orient_factor") if mode == "match" else count_score(F.col("count_score"), F.col("recall"), F.col("len_factor"), F.col("orient_factor"))
    a = a.withColumn("score", score)
    digits = {"score": 4, "recall": 3, "precision": 3, "fbeta": 3, "orient_err": 1, "count_score": 4, "count_ratio": 3, "len_factor": 3}
    return a.select(*keys, "n", "n_gt", "matched", *[even_round(F.col(c), d).alias(c) for c, d in digits.items()])


def score_unsupervised(fibers: DataFrame, covered: DataFrame, width: int | str, height: int | str) -> DataFrame:
    """Per image (of one size, or of the sizes in the named columns of covered): coverage + 0.4 median straightness - 0.5 if degenerate - 0.3 runaway; -1 without foreground. covered: image_id, coverage (null or missing: no foreground). Images of covered without fibres have n = 0."""
    area = lambda n: F.col(n) if isinstance(n, str) else F.lit(n)
    most = F.greatest(F.lit(20), F.floor(area(width).cast("long") * area(height) / 2000))
    sized = covered.select("image_id", "coverage", most.alias("_cap"))
    # an image that covered doesn't have has the size of all, or none known
    cap = most if not isinstance(width, str) and not isinstance(height, str) else F.coalesce(F.col("_cap"), F.lit(20))
    a = fibers.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("straightness", F.lit(0.5)).alias("straightness"), F.stddev_pop("angle").alias("angle_std"))
    a = a.join(sized, "image_id", "full_outer").fillna(0, ["n"]).fillna(0.0, ["straightness", "angle_std"])
    a = a.withColumn("degenerate", F.when(F.col("coverage").isNull(), True).otherwise((F.col("angle_std") < 8.0) & (F.col("n") > 3))).withColumn("runaway", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("n") / cap - 1.0)))
    score = F.when(F.col("coverage").isNull(), F.lit(-1.0)).otherwise(F.col("coverage") + 0.4 * F.col("straightness") - F.when(F.col("degenerate"), 0.5).otherwise(0.0) - 0.3 * F.col("runaway"))
    return a.select("image_id", "n", even_round(score, 4).alias("score"), even_round(F.coalesce("coverage", F.lit(0.0)), 3).alias("coverage"), even_round(F.col("straightness"), 3).alias("straightness"), even_round(F.col("angle_std"), 1).alias("angle_std"), "degenerate", even_round(F.col("runaway"), 3).alias("runaway"))


def pool_pieces(scores: DataFrame, weight: str = "detected", tolerance: float = 0.15) -> DataFrame:
    """Supervised scores of combos over all pieces: counts add up, means are weighted by max(1, detected) or by area; the count score is formed anew on the totals.

    scores: combo_key, piece_id, n, n_gt, matched, orient_err, len_factor[, in_roi_px].
    """
    w = F.greatest(F.lit(1), F.col("n") if weight == "detected" else F.col("in_roi_px"))
    a = scores.withColumn("_w", w).groupBy("combo_key").agg(F.sum("n").alias("n"), F.sum("n_gt").alias("n_gt"), F.sum("matched").alias("matched"), (F.sum(F.col("orient_err") * F.col("_w")) / F.sum("_w")).alias("orient_err"), (F.sum(F.col("len_factor") * F.col("_w")) / F.sum("_w")).alias("len_factor"))
    truth = F.greatest(F.col("n_gt"), F.lit(1))
    a = a.withColumn("count_ratio", F.col("n") / truth).withColumn("recall", F.col("matched") / truth)
    return a.withColumn("score", count_score(count_closeness(F.col("n"), F.col("n_gt"), tolerance), F.col("recall"), F.col("len_factor"), 1.0 - 0.5 * (F.col("orient_err") / 90.0)))


def combo_key(seed: Column, lmp: Column, ext: Column, link: Column) -> Column:
    three = lambda c: F.format_string("%.3f", g.rounded(c, 3))
    return F.concat_ws("_", g.half_up(seed).cast("string"), three(lmp), three(ext), three(link))


def best_per_combo(rounds: DataFrame) -> DataFrame:
    """The best score of each combo over all rounds (combo_key, round, score); the earlier round wins a tie."""
    return rounds.groupBy("combo_key").agg(F.max_by(F.struct("round", "score"), F.struct("score", -F.col("round"))).alias("_b")).select("combo_key", F.col("_b.round").alias("round"), F.col("_b.score").alias("score"))


def rank_combos(scores: DataFrame, keys: list[str] | None = None, top_k: int = 3) -> DataFrame:
    """rank (1 is best; ties by combo_id), in_band (positive and at least 95 % of the best), keeps_fibers (the first top_k)."""
    keys = keys or []
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ordered = w.orderBy(F.col("score").desc(), "combo_id")
    r = scores.withColumn("rank", F.row_number().over(ordered)).withColumn("_best", F.max("score").over(w))
    return r.withColumn("in_band", (F.col("score") > 0) & (F.col("score") >= 0.95 * F.col("_best"))).withColumn("keeps_fibers", F.col("rank") <= top_k).drop("_best")


def estimate_runs(pieces: DataFrame, combos: int, rounds: int) -> DataFrame:
    """Per image: pieces, largest piece, runs, and whether to refuse or to warn. pieces: image_id, piece_id, pw, ph, search_down."""
    px = F.ceil(F.col("pw") / F.col("search_down")) * F.ceil(F.col("ph") / F.col("search_down"))
    a = pieces.groupBy("image_id").agg(F.count(F.lit(1)).alias("pieces"), F.max(px).alias("largest"))
    a = a.withColumn("runs", F.col("pieces") * combos * max(1, rounds))
    verdict = F.when((F.col("pieces") > 16) | (F.col("largest") > 1200 * 1200), "refuse").when((F.col("runs") > 400) | (F.col("pieces") > 6) | (F.col("largest") > 700 * 700), "warn").otherwise("run")
    return a.withColumn("verdict", verdict)


def refine_grid(best: DataFrame, round_: int) -> DataFrame:
    """The next grid around the best values (columns seed, sensitivity, bend, link): finer with each round."""
    r = float(round_ + 1)
    clamp = lambda c, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))
    seed = F.col("seed").cast("double")
    step = F.greatest(F.lit(1.0), g.half_up(seed * F.lit(0.4 / r)).cast("double"))
    angle, sense = max(4.0, 18.0 / r), max(0.03, 0.1 / r)
    around = lambda c, d, lo, hi: unique_values(F.array(clamp(F.col(c) - d, lo, hi), F.col(c).cast("double"), clamp(F.col(c) + d, lo, hi)))
    seeds = F.array_distinct(F.array(F.greatest(F.lit(2.0), seed - step), seed, seed + step, F.greatest(F.lit(2.0), g.half_up(seed / 2).cast("double"))))
    return best.select(*[c for c in best.columns if c not in ("seed", "sensitivity", "bend", "link")], seeds.alias("seed"), around("sensitivity", sense, 0.02, 0.9).alias("sensitivity"), around("bend", angle, 5, 89).alias("bend"), around("link", angle, 0, 89).alias("link"))


#: Combos that one sweep takes at most; callers cap their grids far below.
MOST_COMBOS = 10_000


def few_rows(combos: DataFrame) -> list:
    """The rows of combos, MOST_COMBOS at most, or an error."""
    rows = combos.limit(MOST_COMBOS + 1).collect()
    if len(rows) > MOST_COMBOS:
        raise ValueError(f"more than {MOST_COMBOS} combos")
    return rows


def sweep_lines(gray: DataFrame, keys: list[str], combos: DataFrame, **limits) -> DataFrame:
    """The built-in detector's lines for every group of dense grey pixels and combo (combo_id, level[, low, high]): detect()'s columns and combo_id.

    The grey pixels are shuffled once, however many combos there are; combos of one setting share its lines until the last step.
    """
    of: dict[tuple, list] = {}
    for r in few_rows(combos):
        of.setdefault((r.level, *((r.low, r.high) if "low" in combos.columns else (40, 120))), []).append(r.combo_id)
    ids = F.array(*[F.array(*[F.lit(i).cast(combos.schema["combo_id"].dataType) for i in same]) for same in of.values()]) if of else F.array().cast("array<array<long>>")
    found = detect_settings(gray, keys, list(of), **limits)
    return found.withColumn("combo_id", F.explode(F.get(ids, F.col("setting")))).drop("setting")


#: Ends within STEP are a step of one line, as the detector's own gaps are; from there to REACH they are linked across a gap.
STEP, REACH = 5.0, 15.0


def combo_fibers(gray: DataFrame, keys: list[str], combos: DataFrame, **limits) -> DataFrame:
    """The built-in detector's fibres for every group of dense grey pixels and combo (combo_id, level, seed, bend, link): keys, combo_id and the columns of fibres.

    The grey pixels are shuffled once; combos of one level share its lines, on which the other axes act (`combined`).
    """
    rows = few_rows(combos)
    levels = sorted({r.level for r in rows})
    return combined(detect_settings(gray, keys, [(v, 40, 120) for v in levels], **limits), keys, levels, rows)


def combined(lines: DataFrame, keys: list[str], levels: list[float], combos: list) -> DataFrame:
    """What combos (rows of combo_id, level, seed, bend, link) make of the lines (keys, setting, detect()'s columns) found at each level (setting: its place in levels): keys, combo_id and the columns of fibres.

    seed: lines start at their centres, and no two start nearer than that; in rounds the longer one stays, then the lower id. bend: ends within STEP
    are joined if the path turns by so many degrees at most. link: the same for ends further apart, up to REACH. Ends choose their nearest in rounds.
    """
    starts = sorted({(r.level, r.seed) for r in combos})
    at_level = [[i for i, s in enumerate(starts) if s[0] == v] for v in levels]
    at_start = [[r for r in combos if (r.level, r.seed) == s] for s in starts]
    group = lambda *more: F.struct(*[F.col(f"image_id.{k}").alias(k) for k in keys], *more).alias("image_id")
    each = lambda lists, kind, at: F.explode(F.get(F.array(*[F.array(*x) for x in lists]) if lists else F.array().cast(f"array<array<{kind}>>"), at))

    found = written(lines.select(F.struct(*keys, "setting").alias("image_id"), F.lit(0).alias("tile_id"), *[c for c in lines.columns if c not in (*keys, "setting")]))
    side = lambda s: found.select("image_id", F.col("fiber_id").alias(s), F.col("center.x").alias(f"{s}x"), F.col("center.y").alias(f"{s}y"), F.col("length_arc").alias(f"{s}_long"))
    near = near_pairs(side("a"), side("b"), "ax", "ay", "bx", "by", max([s[1] for s in starts], default=0.0), ["image_id"]).where("a_long > b_long or (a_long = b_long and a < b)")
    begun = each([[F.lit(i) for i in x] for x in at_level], "int", F.col("image_id.setting"))
    too_near = near.withColumn("start", begun).where(F.col("dist") < F.get(F.array(*[F.lit(float(s[1])) for s in starts]), F.col("start")))
    gone = settled(too_near.select(group("start"), F.col("a").alias("better"), F.col("b").alias("worse")))
    spaced = found.withColumn("start", begun).select(group("start"), *found.columns[1:])
    spaced = written(spaced.join(unsent(gone.withColumnRenamed("worse", "fiber_id")), ["image_id", "fiber_id"], "left_anti").select(*found.columns))

    of = [[F.struct(F.lit(r.combo_id).alias("combo_id"), F.lit(float(r.bend)).alias("bend"), F.lit(float(r.link)).alias("link")) for r in x] for x in at_start]
    chosen = each(of, "struct<combo_id: long, bend: double, link: double>", F.col("image_id.start"))
    near = turning_ends(spaced, REACH).withColumn("_c", chosen).where(F.col("turn") <= F.when(F.col("gap") <= STEP, F.col("_c.bend")).otherwise(F.col("_c.link")))
    links = cut(match_ends(near.select(group("_c.combo_id"), "a", "a_end", "b", "b_end", "gap", F.lit(False).alias("same_tile"))))
    every = written(spaced.withColumn("_c", chosen).select(group("_c.combo_id"), *found.columns[1:]))
    return joined_by(every, links).select("image_id.*", *[c for c in found.columns if c not in ("image_id", "tile_id")])


def sweep(tiles_px: DataFrame, combos: DataFrame, detect) -> DataFrame:
    """detect() for every tile and combo. Combos are parameters: their rows (MOST_COMBOS at most, or an error) become part of the plan, so nothing is joined.

    With a tracer whose schema has an `error` column, a combo that fails on a tile gives a status row and doesn't stop the others.
    """
    rows = few_rows(combos)
    each = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, combos.schema)]) for r in rows]) if rows else F.array().cast(f"array<{combos.schema.simpleString()}>")
    return detect(tiles_px.withColumn("_combo", F.explode(each)).select(*tiles_px.columns, "_combo.*"))


def suggest(spark: SparkSession, score_round, start: dict, rounds: int = 3, gain: float = 1e-4) -> DataFrame:
    """Iterative search: each round scores a grid in one Spark job and re-centres a finer one; the driver sees one row a round.

    score_round(combos) -> combo_id, score. start: axis -> list of values, in the order seed, sensitivity, bend, link.
    Returns round, combo_id, the axes and best score of every scored combo, with rank (1 is best; the earlier round and combo of equal ones) and in_band.
    """
    axes, seen, last = ["seed", "sensitivity", "bend", "link"], [], None
    grid = spark.createDataFrame([tuple([float(v) for v in start[a]] for a in axes)], ", ".join(f"{a} array<double>" for a in axes))
    for k in range(max(1, rounds)):
        combos = param_grid(grid, axes, None)
        scored = cut(combos.join(score_round(combos), "combo_id").withColumn("round", F.lit(k)))
        best = scored.orderBy(F.col("score").desc(), "combo_id").limit(1)
        row = best.first()
        seen.append(scored)
        if row is None or last is not None and row.score <= last + gain:
            break
        last = row.score
        grid = refine_grid(best.select(*axes), k)
    every = reduce(DataFrame.unionByName, seen)
    keyed = every.withColumn("combo_key", combo_key(*[F.col(a) for a in axes]))
    w = Window.partitionBy("combo_key").orderBy(F.col("score").desc(), "round", "combo_id")
    best = keyed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    # a search scores a few hundred combos at most
    whole = Window.partitionBy(F.lit(0))
    return best.withColumn("rank", F.row_number().over(whole.orderBy(F.col("score").desc(), "round", "combo_id"))).withColumn("in_band", (F.col("score") > 0) & (F.col("score") >= 0.95 * F.max("score").over(whole)))
