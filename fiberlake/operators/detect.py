"""Fibre detection on tiles: edges, Hough votes and segments, user tracers, retries and seed graphs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fiberlake.functions import geometry as g
from fiberlake.operators.rounds import components, cut, dealt, unsent, written
from fiberlake.operators.seams import near_pairs


#: Side of the blocks in which edge pixels are joined at once; a block is a row of at most SIDE * SIDE codes.
SIDE = 256


def runs_joined(places: np.ndarray, width: int) -> np.ndarray:
    """For each of some places (y * width + x, ascending, x never 0 or width - 1) the first place of its eight-connected part.

    Pixels side by side are one run; runs that touch in neighbouring rows are united by a union-find over arrays.
    """
    new = np.concatenate(([True], places[1:] != places[:-1] + 1))
    start = places[new]
    end = places[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(places) - 1]))]
    # runs of the next row that reach into the columns of this run, one further on each side
    lo, hi = np.searchsorted(end, start + width - 1), np.searchsorted(start, end + width + 1, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(start)), n)
    b = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    label = np.arange(len(start))
    while len(a):
        one, other = label[a], label[b]
        apart = one != other
        if not apart.any():
            break
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while (label[label] != label).any():
            label = label[label]
    return start[label][np.cumsum(new) - 1]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _parts(codes: pd.Series) -> pd.Series:
    """Of each block's codes (place * 2 + strong, places with a rim of one): place, part's first place * 2 + strong, alternating."""
    out, wide = [], SIDE + 2
    for c in codes:
        code = np.sort(np.asarray(c, np.int64))
        place, strong = code >> 1, code & 1
        first = runs_joined(place, wide)
        parts, of = np.unique(first, return_inverse=True)
        any_strong = np.zeros(len(parts), np.int64)
        np.maximum.at(any_strong, of, strong)
        out.append(np.column_stack((place, first * 2 + any_strong[of])).reshape(-1))
    return pd.Series(out, dtype=object)


def edge_parts(edges: DataFrame) -> DataFrame:
    """image_id, x, y, px, py (the first pixel of the part of its block that it belongs to), strong (the part holds a strong pixel). edges: one row a pixel."""
    bx, by = (F.floor(F.col(c) / F.lit(SIDE)) for c in "xy")
    place = (F.col("y") - F.col("_by") * SIDE) * (SIDE + 2) + (F.col("x") - F.col("_bx") * SIDE) + 1
    blocks = edges.withColumn("_bx", bx).withColumn("_by", by).groupBy("image_id", "_bx", "_by").agg(F.collect_list(place * 2 + F.col("strong").cast("int")).alias("_codes"))
    found = blocks.select("image_id", "_bx", "_by", _parts("_codes").alias("_f"))
    each = found.select("image_id", "_bx", "_by", F.explode(F.transform(F.sequence(F.lit(0), F.size("_f") - 1, F.lit(2)), lambda i: F.struct(F.get("_f", i).alias("p"), F.get("_f", i + 1).alias("q")))).alias("_e"))
    first = F.shiftright("_e.q", 1)
    x = lambda p: (F.col("_bx") * SIDE + p % (SIDE + 2) - 1).cast("int")
    y = lambda p: (F.col("_by") * SIDE + F.floor(p / F.lit(SIDE + 2))).cast("int")
    return each.select("image_id", x(F.col("_e.p")).alias("x"), y(F.col("_e.p")).alias("y"), x(first).alias("px"), y(first).alias("py"), (F.col("_e.q") % 2 == 1).alias("strong"))


def hysteresis(edges: DataFrame) -> DataFrame:
    """Edge pixels that are strong or joined to a strong one through neighbours.

    Pixels are joined inside blocks first, each block in one step however long its chains are; only parts that touch a
    part of another block go on to rounds, which are few since labels double their reach. edges: image_id, x, y, strong,
    one row a pixel; no pixel at all gives none.
    """
    return joined_parts(cut(edge_parts(edges)))


def joined_parts(parts: DataFrame) -> DataFrame:
    """The pixels of parts (as edge_parts gives them, written once) that hold a strong pixel or touch, through other blocks' parts, one that does."""
    at_rim = lambda c: F.pmod(c, F.lit(SIDE)).isin(0, SIDE - 1)
    rim = parts.where(at_rim(F.col("x")) | at_rim(F.col("y")))
    part = lambda df: F.struct(df["image_id"], df["py"], df["px"])
    block = lambda c: F.floor(c / F.lit(SIDE))
    # each pair of neighbours once: the ones to the right and below
    around = F.expr("array(struct(1 as i, 0 as j), struct(-1 as i, 1 as j), struct(0 as i, 1 as j), struct(1 as i, 1 as j))")
    out = rim.select("image_id", "x", "y", part(rim).alias("a"), F.explode(around).alias("_o")).withColumn("nx", F.col("x") + F.col("_o.i")).withColumn("ny", F.col("y") + F.col("_o.j"))
    out = out.where((block(F.col("nx")) != block(F.col("x"))) | (block(F.col("ny")) != block(F.col("y")))).select("image_id", F.col("nx").alias("x"), F.col("ny").alias("y"), "a")
    links = cut(out.join(unsent(rim.select("image_id", "x", "y", part(rim).alias("b"))), ["image_id", "x", "y"]).select("a", "b").distinct())
    sure = parts.where("strong").select("image_id", "x", "y")
    if not links.limit(1).count():
        return sure
    strong = parts.where("strong").select(part(parts).alias("node"), F.lit(True).alias("_s")).distinct()
    joined = components(links).join(unsent(strong), "node", "left")
    lit = joined.groupBy("label").agg(F.max("_s").alias("_lit")).where("_lit")
    saved = joined.where("_s is null").join(lit, "label", "left_semi").select(F.col("node.image_id").alias("image_id"), F.col("node.py").alias("py"), F.col("node.px").alias("px"))
    return sure.union(parts.where("not strong").join(unsent(saved), ["image_id", "py", "px"], "left_semi").select("image_id", "x", "y"))


#: Columns and rows of other blocks that a block's gradients and their neighbours need.
HALO = 2
PLACES = SIDE * (SIDE + 2)


def ridges(grey: np.ndarray, inner: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(ridge, strong) of a grey array without its outer two rows and columns: thin_edges on one array. inner: pixels that have a gradient; NaN has none."""
    smooth, step = grey[:-2] + 2 * grey[1:-1] + grey[2:], grey[2:] - grey[:-2]
    gx, gy = np.zeros(grey.shape), np.zeros(grey.shape)
    gx[1:-1, 1:-1] = smooth[:, 2:] - smooth[:, :-2]
    gy[1:-1, 1:-1] = step[:, :-2] + 2 * step[:, 1:-1] + step[:, 2:]
    m = np.abs(gx) + np.abs(gy)
    m[~inner | np.isnan(m)] = -1
    rows, columns = m.shape
    at = lambda dx, dy: m[2 + dy : rows - 2 + dy, 2 + dx : columns - 2 + dx]
    here, gx, gy = at(0, 0), gx[2:-2, 2:-2], gy[2:-2, 2:-2]
    ax, ay = np.abs(gx) * 1000, np.abs(gy) * 1000
    sector = [ay < np.abs(gx) * 414, ay > np.abs(gx) * 2414, (gx >= 0) == (gy >= 0)]
    before = np.select(sector, [at(-1, 0), at(0, -1), at(-1, -1)], at(-1, 1))
    after = np.select(sector, [at(1, 0), at(0, 1), at(1, 1)], at(1, -1))
    # a neighbour without a gradient hinders nothing
    ridge = (here >= 0) & (here > low) & (before < here) & (after <= here)
    return ridge, ridge & (here > high)


def setting_parts(gray: DataFrame, settings: list[tuple], keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """edge_parts of dense grey images (keys, x, y, g, width, height) at each setting (level, low, high): keys, setting (its place in the list), x, y, px, py, strong.

    What is not above the level is background (None: all is kept). Pixels go to blocks once, however many settings there are; a block is thinned
    and joined at all of them in one step. Pixels that are dealt out by one of the keys stay where they are.
    """
    wide = SIDE + 2 * HALO

    def found(block: pa.Table) -> pa.Table:
        i, j, w, h = (block[c][0].as_py() for c in ("_bx", "_by", "width", "height"))
        y, x = np.divmod(block["_p"].to_numpy(), wide)
        grey = np.full((min(wide, y.max() + 1 + HALO), min(wide, x.max() + 1 + HALO)), np.nan)
        grey[y, x] = block["g"].to_numpy()
        in_y, in_x = (np.arange(n) + at * SIDE - HALO for n, at in zip(grey.shape, (j, i)))
        inner = ((in_y > 0) & (in_y < h - 1))[:, None] & ((in_x > 0) & (in_x < w - 1))[None, :]
        out = []
        for k, (level, low, high) in enumerate(settings):
            ridge, strong = ridges(grey if level is None else np.where(grey > level, grey, 0.0), inner, low, high)
            ry, rx = np.nonzero(ridge)
            if not len(ry):
                continue
            first = runs_joined(ry * (SIDE + 2) + rx + 1, SIDE + 2)
            parts, of = np.unique(first, return_inverse=True)
            any_strong = np.zeros(len(parts), bool)
            np.logical_or.at(any_strong, of, strong[ry, rx])
            py, px = np.divmod(first, SIDE + 2)
            out.append((np.full(len(ry), k), i * SIDE + rx, j * SIDE + ry, i * SIDE + px - 1, j * SIDE + py, any_strong[of]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * 5 + [np.empty(0, bool)]
        return with_keys(block, [*keys], {n: c if n == "strong" else c.astype(np.int32) for n, c in zip(("setting", "x", "y", "px", "py", "strong"), columns)})

    def blocks(c: str, size: str) -> Column:
        lo = F.greatest(F.lit(0), F.floor((F.col(c) - HALO) / F.lit(SIDE)).cast("int"))
        hi = F.least(F.floor((F.col(size) - 1) / F.lit(SIDE)), F.floor((F.col(c) + HALO) / F.lit(SIDE))).cast("int")
        return F.explode(F.when(lo == hi, F.array(lo)).otherwise(F.array(lo, hi)))

    put = gray.withColumn("_bx", blocks("x", "width")).withColumn("_by", blocks("y", "height"))
    place = ((F.col("y") - F.col("_by") * SIDE + HALO) * wide + F.col("x") - F.col("_bx") * SIDE + HALO).cast("int")
    listed = put.select(*keys, "_bx", "_by", place.alias("_p"), F.coalesce(F.col("g").cast("float"), F.lit(float("nan")).cast("float")).alias("g") if dict(gray.dtypes)["g"] in ("int", "smallint", "tinyint") else F.coalesce(F.col("g").cast("double"), F.lit(float("nan"))).alias("g"), "width", "height")
    return listed.groupBy(*keys, "_bx", "_by").applyInArrow(found, T.StructType([*key_fields(gray, keys), *[T.StructField(c, T.IntegerType()) for c in ("setting", "x", "y", "px", "py")], T.StructField("strong", T.BooleanType())]))


def with_keys(block: pa.Table, keys: list[str], columns: dict[str, np.ndarray]) -> pa.Table:
    """columns with the keys of a group, which are the same in all of its rows."""
    n = len(next(iter(columns.values())))
    first = pa.array(np.zeros(n, np.int64))
    return pa.table({k: block[k].slice(0, 1).combine_chunks().take(first) for k in keys} | {k: pa.array(v) for k, v in columns.items()})


def setting_edges(gray: DataFrame, keys: list[str], settings: list[tuple]) -> DataFrame:
    """keys, setting, x, y of the edge pixels of each group (a tile, say) of dense grey pixels (keys, x, y, g, width, height) at each setting (level, low, high)."""
    parts = written(setting_parts(gray, settings, keys).select(F.struct(*keys, "setting").alias("image_id"), "x", "y", "px", "py", "strong"))
    return joined_parts(parts).select("image_id.*", "x", "y")


def edges(gray: DataFrame, low: int = 40, high: int = 120) -> DataFrame:
    """Edge pixels of dense grey images: gradient ridges over two thresholds."""
    return edge_points(gray, ["image_id"], low, high)


def edge_points(gray: DataFrame, keys: list[str], low: int = 40, high: int = 120) -> DataFrame:
    """keys, x, y of the edge pixels of each group (a tile, say) of dense grey pixels (keys, x, y, g, width, height)."""
    return setting_edges(gray, keys, [(None, low, high)]).drop("setting")


ANGLES = 180
#: Votes that a task forms at once.
AT_ONCE = 1 << 19


def lines_through(x: np.ndarray, y: np.ndarray, turns: np.ndarray):
    """For a few of the angles at a time (degrees): where they begin in turns, and rho of each angle and point."""
    step = max(1, AT_ONCE // max(1, len(x)))
    for lo in range(0, len(turns), step):
        turn = np.radians(turns[lo : lo + step])[:, None]
        yield lo, np.floor(np.floor((x * np.cos(turn) + y * np.sin(turn)) * 1e9 + 0.5) / 1e9 + 0.5).astype(np.int64)


def block_votes(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """theta, rho, votes of the lines with at least so many votes of some points."""
    out = [(np.empty(0, np.int64),) * 3]
    for first, rho in lines_through(x.astype(float), y.astype(float), np.arange(ANGLES)):
        low = rho.min()
        wide = int(rho.max() - low) + 1
        n = np.bincount(((np.arange(len(rho)) * wide)[:, None] + rho - low).reshape(-1))
        at = np.flatnonzero(n >= least)
        out.append((first + at // wide, low + at % wide, n[at]))
    return tuple(np.concatenate(c) for c in zip(*out))


def in_blocks(points: DataFrame) -> DataFrame:
    return points.withColumn("_bx", F.floor(F.col("x") / F.lit(SIDE)).cast("int")).withColumn("_by", F.floor(F.col("y") / F.lit(SIDE)).cast("int"))


def key_fields(df: DataFrame, keys) -> list[T.StructField]:
    return [T.StructField(k, df.select(k).schema[k].dataType) for k in keys]


def votes(points: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Each pixel votes for a line at each of 180 angles: keys, theta (degrees), rho (whole pixels), votes (`least` or more).

    The votes of a block of SIDE x SIDE pixels are counted where they arise; only its lines are shuffled, and of a group of a single block only those with
    `least` votes. A task holds the lines of one block at a time.
    """
    w = Window.partitionBy(*keys)
    alone = (F.min("_bx").over(w) == F.max("_bx").over(w)) & (F.min("_by").over(w) == F.max("_by").over(w))
    put = in_blocks(points.select(*keys, "x", "y")).withColumn("_alone", alone)

    def counted(block: pa.Table) -> pa.Table:
        theta, rho, n = block_votes(block["x"].to_numpy(), block["y"].to_numpy(), least if block["_alone"][0].as_py() else 1)
        return with_keys(block, keys, {"theta": theta.astype(np.int32), "rho": rho.astype(np.int32), "n": n.astype(np.int64)})

    schema = T.StructType([*key_fields(points, keys), T.StructField("theta", T.IntegerType()), T.StructField("rho", T.IntegerType()), T.StructField("n", T.LongType())])
    cells = dealt(put, *keys, "_bx", "_by").groupBy(*keys, "_bx", "_by").applyInArrow(counted, schema)
    return cells.groupBy(*keys, "theta", "rho").agg(F.sum("n").alias("votes")).where(F.col("votes") >= least)


def peaks(all_votes: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """Lines with at least so many votes that are the best of their 3 x 3 neighbourhood (then the lower theta and rho)."""
    key = F.struct(F.col("votes").alias("v"), (-F.col("theta")).alias("t"), (-F.col("rho")).alias("r"))
    around = F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i as i, j as j))))")
    # each line tells its neighbours and itself its votes; lines are few, so a join with empty places isn't needed
    told = all_votes.where(F.col("votes") >= least).withColumn("_k", key).withColumn("_o", F.explode(around))
    told = told.withColumn("_own", F.when((F.col("_o.i") == 0) & (F.col("_o.j") == 0), F.col("_k"))).withColumn("theta", F.col("theta") + F.col("_o.i")).withColumn("rho", F.col("rho") + F.col("_o.j"))
    return told.groupBy(*keys, "theta", "rho").agg(F.max("_k").alias("_k"), F.max("_own").alias("_own")).where("_k = _own").select(*keys, "theta", "rho", F.col("_k.v").alias("votes"))


def on_lines(points: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, theta, rho, votes, x, y: the points of each group on each of its lines (keys, theta, rho, votes), found in blocks."""
    put = in_blocks(points.select(*keys, "x", "y"))
    block = [*keys, "_bx", "_by"]
    # keys of another name: both sides come from the same points
    told = put.select(*block).distinct().join(unsent(lines), keys).select(*[F.col(c).alias(f"_of_{c}") for c in block], "theta", "rho", "votes")

    def met(some: pa.Table, of: pa.Table) -> pa.Table:
        x, y = some["x"].to_numpy(), some["y"].to_numpy()
        theta, rho, n = (of[c].to_numpy().astype(np.int64) for c in ("theta", "rho", "votes"))
        out = [(np.empty(0, np.int64),) * 2]
        if len(x) and len(theta):
            turns, turn = np.unique(theta, return_inverse=True)
            low = rho.min()
            wide = int(rho.max() - low) + 1
            code = turn * wide + rho - low
            order = np.argsort(code)
            for first, at in lines_through(x.astype(float), y.astype(float), turns):
                i, k = np.nonzero((at >= low) & (at < low + wide))
                sought = (first + i) * wide + at[i, k] - low
                place = np.minimum(np.searchsorted(code, sought, sorter=order), len(code) - 1)
                hit = code[order[place]] == sought
                out.append((order[place[hit]], k[hit]))
        line, k = (np.concatenate(c) for c in zip(*out))
        return with_keys(some, keys, {"theta": theta[line].astype(np.int32), "rho": rho[line].astype(np.int32), "votes": n[line], "x": x[k].astype(np.int32), "y": y[k].astype(np.int32)}) if len(k) else nothing

    schema = T.StructType([*key_fields(points, keys), *[T.StructField(c, T.LongType() if c == "votes" else T.IntegerType()) for c in ("theta", "rho", "votes", "x", "y")]])
    nothing = to_arrow_schema(schema).empty_table()
    return dealt(put, *block).groupBy(*block).cogroup(told.groupBy(*[f"_of_{c}" for c in block])).applyInArrow(met, schema)


def hough_segments(points: DataFrame, keys: list[str], least: int = 30, min_len: float = 15, max_gap: float = 5, most: int = 500) -> DataFrame:
    """Segments along the peak lines: pixels in order along the line, cut where the gap is larger than max_gap; the `most` longest of each group.

    The cap is the reference behaviour's own limit on lines of one tile.
    """
    p = peaks(votes(points, keys, least), keys, least)
    on = on_lines(points, p, keys).withColumn("t", g.rounded(F.col("y") * F.cos(F.radians("theta")) - F.col("x") * F.sin(F.radians("theta")), 9))
    line = [*keys, "theta", "rho"]
    w = Window.partitionBy(*line).orderBy("t", "x", "y")
    cut_at = on.withColumn("_new", F.when(F.col("t") - F.lag("t").over(w) > max_gap, 1).otherwise(0)).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = cut_at.groupBy(*line, "votes", "part").agg(F.min_by(F.struct("x", "y"), F.struct("t", "x", "y")).alias("a"), F.max_by(F.struct("x", "y"), F.struct("t", "x", "y")).alias("b"), F.count(F.lit(1)).alias("pixels"))
    s = s.withColumn("length", g.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))).where(F.col("length") >= min_len)
    order = Window.partitionBy(*keys).orderBy(F.col("length").desc(), "theta", "rho", "part")
    return s.withColumn("seg_id", F.row_number().over(order) - 1).where(F.col("seg_id") < most).select(*keys, "seg_id", "theta", "rho", "votes", "pixels", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), "length")


def as_fibers(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments as fibres of two points; the width is unknown."""
    a, b = g.point(F.col("ax"), F.col("ay")), g.point(F.col("bx"), F.col("by"))
    return segments.select(
        *keys, F.col("seg_id").cast("long").alias("fiber_id"), F.array(a, b).alias("points"), g.point((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2).alias("center"),
        g.axis_angle(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("angle"), F.col("length").alias("length_arc"), F.col("length").alias("length_end"), F.lit(None).cast("double").alias("width"), F.lit(1.0).alias("straightness"),
    )


def detect(tile_pixels: DataFrame, keys: list[str], tracer=None, schema: str | None = None, edge: bool = True, low: int = 40, high: int = 120, **limits) -> DataFrame:
    """Fibres of each group of pixels. By default lines by Hough votes of edge pixels: dense grey pixels (keys, x, y, g, width, height) are thinned to
    gradient ridges over two thresholds with hysteresis first. With edge=False all given pixels (keys, x, y) vote.

    tracer(key, pandas frame) -> pandas frame of `schema` traces one group (a tile, whose size is bounded by the tiling);
    its groups run in parallel. A tracer that fails gives a status row instead of stopping the job, if schema has an
    `error` column.
    """
    if tracer is None:
        points = written(edge_points(tile_pixels, keys, low, high)) if edge else tile_pixels.select(*keys, "x", "y")
        return as_fibers(hough_segments(points, keys, **limits), keys)
    import pandas as pd

    names = [c.split()[0] for c in schema.split(",")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return tracer(key, pdf)
        except Exception as x:
            if "error" not in names:
                raise
            return pd.DataFrame([{**dict(zip(keys, key)), "error": str(x)[:200]}]).reindex(columns=names)

    return tile_pixels.groupBy(*keys).applyInPandas(run, schema)


def detect_settings(gray: DataFrame, keys: list[str], settings: list[tuple], **limits) -> DataFrame:
    """detect() at each setting (level, low, high) with its place in the list as `setting`; what is not above the level is background."""
    each = [*keys, "setting"]
    return as_fibers(hough_segments(written(setting_edges(gray, keys, settings)), each, **limits), each)


def retry_dense(gray: DataFrame, keys: list[str], budget: int, threshold: Column | float = 5.0, spacing: float = 2.0, attempts: int = 4) -> DataFrame:
    """Per tile: the threshold and seed spacing at which its foreground fits the budget, eased up to attempts - 1 times; raised and ok say how it went.

    threshold: a number, or a Column that is the same for all pixels of a tile.
    """
    steps = [(threshold if isinstance(threshold, Column) else F.lit(float(threshold)), float(spacing))]
    for _ in range(attempts - 1):
        t, s = steps[-1]
        steps.append((F.least(F.lit(254.0), t * 1.4 + 5.0), float(int(max(2.0, s) * 2.0))))
    counts = gray.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels"), *[F.sum(F.when(F.col("g") > t, 1).otherwise(0)).alias(f"_n{i}") for i, (t, _) in enumerate(steps)], *[F.max(t).alias(f"_t{i}") for i, (t, _) in enumerate(steps)])
    fits = [F.col(f"_n{i}") <= budget for i in range(attempts)]
    last = attempts - 1
    pick = lambda values: _first(fits, values, values[last])
    return counts.select(*keys, pick([F.col(f"_t{i}") for i in range(attempts)]).alias("threshold"), pick([F.lit(s) for _, s in steps]).alias("spacing"), pick([F.col(f"_n{i}") for i in range(attempts)]).alias("foreground"), pick([F.lit(i + 1) for i in range(attempts)]).alias("attempts"), (~fits[0]).alias("raised"), _first(fits, [F.lit(True)] * attempts, F.lit(False)).alias("ok"), "pixels")


def _first(tests, values, otherwise):
    out = F.when(tests[0], values[0])
    for t, v in zip(tests[1:], values[1:]):
        out = out.when(t, v)
    return out.otherwise(otherwise)


def seed_pairs(seeds: DataFrame, reach: float, bend: float = 70.0) -> DataFrame:
    """Pairs of nearby seeds (image_id, seed_id, x, y) that have a third one beyond them in nearly the same direction: pieces of ridges. An approximation of a tracer's linking.

    a, b: the pair; c: the nearest seed that continues it with a bend of at most `bend` degrees.
    """
    a = seeds.select("image_id", F.col("seed_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = seeds.select("image_id", F.col("seed_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pairs = near_pairs(a, b, "ax", "ay", "bx", "by", reach, ["image_id"]).where("a <> b")
    on = pairs.select("image_id", F.col("a").alias("b"), F.col("b").alias("c"), F.col("bx").alias("cx"), F.col("by").alias("cy"), F.col("dist").alias("dist2"))
    t = pairs.join(on, ["image_id", "b"]).where("a <> c")
    dot = ((F.col("bx") - F.col("ax")) * (F.col("cx") - F.col("bx")) + (F.col("by") - F.col("ay")) * (F.col("cy") - F.col("by"))) / (F.col("dist") * F.col("dist2"))
    straight = t.where((F.col("dist") > 0) & (F.col("dist2") > 0)).withColumn("cosine", dot).where(F.col("cosine") >= math.cos(math.radians(bend)))
    best = Window.partitionBy("image_id", "a", "b").orderBy("dist2", "c")
    return straight.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("image_id", "a", "b", "c", "dist", "cosine")
