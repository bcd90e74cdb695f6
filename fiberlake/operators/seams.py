"""Seams between tiles: duplicates and broken fibres, by distance joins on grid cells and rounds of matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiberlake.functions import geometry as g
from fiberlake.operators.fibers import measured
from fiberlake.operators.rounds import cut, unsent, written

ENDS = (0, 1)


def near_pairs(a: DataFrame, b: DataFrame, ax: str, ay: str, bx: str, by: str, reach: float, keys: list[str]) -> DataFrame:
    """Rows of a and b within reach: an equi-join on grid cells twice as wide (b is sent to those that are within reach of it, four at most), then the exact distance (column dist)."""
    # a touch further than the reach, lest rounding parts a pair
    wide, size = reach * (1 + 1e-6) + 1e-6, F.lit(2.0 * reach * (1 + 1e-5) + 1e-5)
    cell = lambda c: F.floor(c / size)
    left = a.withColumn("_gx", cell(F.col(ax))).withColumn("_gy", cell(F.col(ay)))
    cells = lambda c: F.explode(F.sequence(cell(F.col(c) - wide), cell(F.col(c) + wide)))
    right = b.withColumn("_gx", cells(bx)).withColumn("_gy", cells(by))
    met = left.join(unsent(right), [*keys, "_gx", "_gy"]).drop("_gx", "_gy")
    return met.withColumn("dist", g.distance(F.col(ax), F.col(ay), F.col(bx), F.col(by))).where(F.col("dist") <= reach)


def dedup_candidates(fibers: DataFrame, tol: float = 4.0) -> DataFrame:
    """Pairs of fibres of different tiles that may be one: image_id, better, worse (the longer is better, then the lower id)."""
    cols = ["tile_id", "fiber_id", "angle", "length_arc"]
    a = fibers.select("image_id", F.col("center.x").alias("ax"), F.col("center.y").alias("ay"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = fibers.select("image_id", F.col("center.x").alias("bx"), F.col("center.y").alias("by"), *[F.col(c).alias(f"b_{c}") for c in cols])
    p = near_pairs(a, b, "ax", "ay", "bx", "by", tol, ["image_id"]).where("a_tile_id <> b_tile_id and a_fiber_id <> b_fiber_id")
    longer = (F.col("a_length_arc") > F.col("b_length_arc")) | ((F.col("a_length_arc") == F.col("b_length_arc")) & (F.col("a_fiber_id") < F.col("b_fiber_id")))
    same = (g.acute_difference(F.col("a_angle"), F.col("b_angle")) <= 20) & (F.col("a_length_arc") > 0) & (F.col("b_length_arc") / F.col("a_length_arc") >= 0.5)
    return p.where(longer & same).select("image_id", F.col("a_fiber_id").alias("better"), F.col("b_fiber_id").alias("worse"))


def dedup_once(fibers: DataFrame, tol: float = 4.0) -> DataFrame:
    """Drops each fibre that has a better one near, whether or not that one stays."""
    worse = dedup_candidates(fibers, tol).select("image_id", F.col("worse").alias("fiber_id")).distinct()
    return fibers.join(worse, ["image_id", "fiber_id"], "left_anti").select(*fibers.columns)


def dedup_fibers(fibers: DataFrame, tol: float = 4.0) -> DataFrame:
    """Keeps every undecided fibre without an undecided better neighbour and drops its neighbours, in rounds, until all are decided."""
    fibers = written(fibers)
    gone = settled(dedup_candidates(fibers, tol))
    return fibers.join(gone.withColumnRenamed("worse", "fiber_id"), ["image_id", "fiber_id"], "left_anti").select(*fibers.columns)


def settled(pairs: DataFrame) -> DataFrame:
    """image_id, worse: what goes if, in rounds, all that have no undecided better one stay and drop the worse ones beside them. pairs: image_id, better, worse."""
    open_pairs = cut(pairs.select("image_id", "better", "worse"))
    dropped = open_pairs.select("image_id", "worse").limit(0)
    while open_pairs.limit(1).count():
        worse = open_pairs.select("image_id", F.col("worse").alias("f")).distinct()
        best = open_pairs.select("image_id", F.col("better").alias("f")).distinct().join(unsent(worse), ["image_id", "f"], "left_anti")
        gone = cut(open_pairs.join(unsent(best.withColumnRenamed("f", "better")), ["image_id", "better"], "left_semi").select("image_id", "worse").distinct())
        dropped = dropped.union(gone)
        left = open_pairs.join(unsent(gone), ["image_id", "worse"], "left_anti").join(unsent(gone.withColumnRenamed("worse", "better")), ["image_id", "better"], "left_anti")
        open_pairs = cut(left.select("image_id", "better", "worse"))
    return dropped


def endpoints(fibers: DataFrame) -> DataFrame:
    """image_id, tile_id, fiber_id, end (0 first, 1 last), x, y, ux, uy (outward unit direction)."""
    p = F.col("points")
    first, second, last, before = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.element_at(p, -1), F.element_at(p, -2)

    def end(which: int, at: Column, inner: Column) -> Column:
        n = g.distance(at["x"], at["y"], inner["x"], inner["y"])
        unit = lambda a: F.when(n > 0, (at[a] - inner[a]) / n).otherwise(at[a] - inner[a])
        return F.struct(F.lit(which).alias("end"), at["x"].alias("x"), at["y"].alias("y"), unit("x").alias("ux"), unit("y").alias("uy"))

    return fibers.where(F.size("points") >= 2).select("image_id", "tile_id", "fiber_id", F.explode(F.array(end(0, first, second), end(1, last, before))).alias("e")).select("image_id", "tile_id", "fiber_id", "e.*")


def _near_ends(fibers: DataFrame, reach: float) -> DataFrame:
    """Pairs of ends of different fibres (a before b by id) within reach: columns a_*, b_* of endpoints, dist, and _dot of their outward directions."""
    e = endpoints(fibers)
    a = e.select("image_id", *[F.col(c).alias(f"a_{c}") for c in e.columns if c != "image_id"])
    b = e.select("image_id", *[F.col(c).alias(f"b_{c}") for c in e.columns if c != "image_id"])
    p = near_pairs(a, b, "a_x", "a_y", "b_x", "b_y", reach, ["image_id"]).where("a_fiber_id < b_fiber_id")
    return p.withColumn("_dot", F.col("a_ux") * F.col("b_ux") + F.col("a_uy") * F.col("b_uy"))


def turning_ends(fibers: DataFrame, reach: float) -> DataFrame:
    """Pairs of ends of different fibres within reach: image_id, a, a_end, b, b_end, gap, turn (degrees by which a path from one into the other turns; 0 if they face each other)."""
    turn = g.rounded(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("_dot"))))), 6)
    return _near_ends(fibers, reach).select("image_id", F.col("a_fiber_id").alias("a"), "a_end", F.col("b_fiber_id").alias("b"), "b_end", F.col("dist").alias("gap"), turn.alias("turn"))


def stitch_candidates(fibers: DataFrame, tol: float = 6.0, angle_tol: float = 45.0, same_tile: bool = False) -> DataFrame:
    """Pairs of ends (a before b by fibre id) of different fibres and tiles that face each other: image_id, a, a_end, b, b_end, gap. same_tile: also those of one tile, told apart by a column same_tile."""
    facing = F.col("_dot") <= -F.cos(F.radians(F.lit(float(angle_tol))))
    out = _near_ends(fibers, tol).where(facing).select("image_id", F.col("a_fiber_id").alias("a"), F.col("a_end").alias("a_end"), F.col("b_fiber_id").alias("b"), F.col("b_end").alias("b_end"), F.col("dist").alias("gap"), F.col("a_tile_id").eqNullSafe(F.col("b_tile_id")).alias("same_tile"))
    return out if same_tile else out.where(~F.col("same_tile")).drop("same_tile")


def match_ends(candidates: DataFrame) -> DataFrame:
    """A matching of ends: the pairs that are each other's nearest, in rounds, until no candidate is left.

    Pieces of one tile (same_tile) join only once one of them has been joined to another: a joined fibre belongs to no tile.
    """
    order = ["gap", "a", "a_end", "b", "b_end"]
    left, taken = cut(candidates.select("image_id", *order, "same_tile")), None
    while True:
        open_ = left.where(~F.col("same_tile"))
        if not open_.limit(1).count():
            break
        # an end may be the a of one pair and the b of another: rank it over both
        sides = open_.select("*", F.explode(F.array(F.struct(F.col("a").alias("f"), F.col("a_end").alias("e")), F.struct(F.col("b").alias("f"), F.col("b_end").alias("e")))).alias("s"))
        ranked = sides.withColumn("r", F.row_number().over(Window.partitionBy("image_id", "s.f", "s.e").orderBy(*order)))
        mutual = cut(ranked.where("r = 1").groupBy("image_id", *order).count().where("count = 2").select("image_id", *order))
        taken = mutual if taken is None else taken.union(mutual)
        used = mutual.select("image_id", F.explode(F.array(F.struct("a", "a_end"), F.struct(F.col("b").alias("a"), F.col("b_end").alias("a_end")))).alias("u")).select("image_id", F.col("u.a").alias("a"), F.col("u.a_end").alias("a_end"))
        left = left.join(used, ["image_id", "a", "a_end"], "left_anti").join(used.select("image_id", F.col("a").alias("b"), F.col("a_end").alias("b_end")), ["image_id", "b", "b_end"], "left_anti")
        joined = used.select("image_id", "a").distinct()
        left = left.join(joined.withColumn("_a", F.lit(True)), ["image_id", "a"], "left").join(joined.select("image_id", F.col("a").alias("b"), F.lit(True).alias("_b")), ["image_id", "b"], "left")
        left = cut(left.select("image_id", *order, (F.col("same_tile") & F.col("_a").isNull() & F.col("_b").isNull()).alias("same_tile")))
    return candidates.select("image_id", *order).limit(0) if taken is None else taken


def stitch_fibers(fibers: DataFrame, tol: float = 6.0, angle_tol: float = 45.0) -> DataFrame:
    """Fibres with the pieces of each chain joined into one.

    Pieces of different tiles join, and a joined piece goes on with pieces of any tile. Every end joins once at most, so that pieces form chains and cycles; a cycle is cut at its longest gap. Chains are
    ordered by pointer doubling from the end with the lower fibre id. The joined fibre has the first piece's id, tile
    and width; class and boundary measures are reset. A joint vertex that coincides is kept once.
    """
    fibers = written(fibers)
    return joined_by(fibers, cut(match_ends(stitch_candidates(fibers, tol, angle_tol, same_tile=True))))


def joined_by(fibers: DataFrame, links: DataFrame) -> DataFrame:
    """Fibres with the pieces of each chain of links (image_id, a, a_end, b, b_end, gap; each end in one at most) joined into one. Both have been written."""
    if not links.limit(1).count():
        return fibers
    placed = ordered_chains(links)
    run = fibers.join(placed, ["image_id", "fiber_id"])
    directed = run.withColumn("points", F.when(F.col("enter") == 0, F.col("points")).otherwise(F.reverse("points")))
    first = lambda c: F.min_by(c, "place").alias(c)
    joined = directed.groupBy("image_id", F.col("chain").alias("fiber_id")).agg(first("tile_id"), first("width"), F.transform(F.sort_array(F.collect_list(F.struct("place", "points"))), lambda s: s["points"]).alias("_p"))
    same = lambda p, q: (F.abs(p["x"] - q["x"]) < 1e-6) & (F.abs(p["y"] - q["y"]) < 1e-6)
    starts = F.transform(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: F.when(i == 0, F.get("_p", i)).when(same(F.element_at(F.get(F.col("_p"), i - 1), -1), F.get(F.get(F.col("_p"), i), F.lit(0))), F.slice(F.get(F.col("_p"), i), F.lit(2), F.size(F.get(F.col("_p"), i)))).otherwise(F.get(F.col("_p"), i)))
    joined = measured(joined.withColumn("points", F.flatten(starts)).drop("_p"))
    rest = fibers.join(placed.select("image_id", "fiber_id"), ["image_id", "fiber_id"], "left_anti")
    typed = dict(fibers.dtypes)
    cols = [F.col(c).cast(typed[c]).alias(c) if c in joined.columns else F.lit(None).cast(typed[c]).alias(c) for c in fibers.columns]
    return rest.select(*fibers.columns).unionByName(joined.select(*cols))


def ordered_chains(links: DataFrame) -> DataFrame:
    """image_id, chain (its lower outer piece), fiber_id, enter (the end at which the chain comes in), place (ascending along the chain). links: image_id, a, a_end, b, b_end, gap; each end in one link at most."""
    # a side is one direction through a piece: entering at `end`, leaving at the other end
    both = links.select("image_id", "a", "a_end", "b", "b_end", "gap").union(links.select("image_id", "b", "b_end", "a", "a_end", "gap"))
    step = both.select("image_id", F.struct(F.col("a").alias("f"), (1 - F.col("a_end")).alias("in")).alias("side"), F.struct(F.col("b").alias("f"), F.col("b_end").alias("in")).alias("next"), "gap")
    pieces = links.select("image_id", F.col("a").alias("f")).union(links.select("image_id", "b")).distinct()
    sides = pieces.select("image_id", F.explode(F.array(F.struct("f", F.lit(0).alias("in")), F.struct("f", F.lit(1).alias("in")))).alias("side"))
    step = cut(_without_cycles(sides, step))
    # next side within a chain; doubling gives each side the chain's last side and the steps to it
    at = cut(sides.join(step, ["image_id", "side"], "left").select("image_id", "side", F.coalesce("next", "side").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    while True:
        on = at.select("image_id", F.col("side").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        new = cut(at.join(on, ["image_id", "to"]).select("image_id", "side", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("_steps") > 0).alias("moved")))
        at = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    # each chain is seen in both directions: from each of its two outer ends. Keep the one that starts at the lower fibre.
    heads = at.groupBy("image_id", "to").agg(F.max_by("side", "steps").alias("head"))
    chosen = heads.where((F.col("head.f") < F.col("to.f")) | ((F.col("head.f") == F.col("to.f")) & (F.col("head.in") == 0)))
    return at.join(chosen, ["image_id", "to"]).select("image_id", F.col("head.f").alias("chain"), F.col("side.f").alias("fiber_id"), F.col("side.in").alias("enter"), (-F.col("steps")).alias("place"))


def _without_cycles(sides: DataFrame, step: DataFrame) -> DataFrame:
    """Steps without the longest gap of each cycle (lowest side of equal ones), in both directions."""
    reach = cut(sides.join(step, ["image_id", "side"], "left").select("image_id", "side", F.col("next").alias("to"), F.struct(F.coalesce("gap", F.lit(-1.0)).alias("gap"), _link("side", "next").alias("link")).alias("top"), F.col("side").alias("low")))
    n = sides.count()
    hops = 1
    while hops <= n:
        on = reach.select("image_id", F.col("side").alias("to"), F.col("to").alias("_to"), F.col("top").alias("_top"), F.col("low").alias("_low"))
        reach = cut(reach.join(on, ["image_id", "to"], "left").select("image_id", "side", F.col("_to").alias("to"), F.greatest("top", F.coalesce("_top", "top")).alias("top"), F.least("low", F.coalesce("_low", "low")).alias("low")))
        hops *= 2
        if not reach.where("to is not null").limit(1).count():
            return step
    worst = reach.where("to is not null").groupBy("image_id", "low").agg(F.max("top").alias("top")).select("image_id", F.col("top.link").alias("link")).distinct()
    return step.withColumn("link", _link("side", "next")).join(worst, ["image_id", "link"], "left_anti").drop("link")


def _link(side: str, to: str) -> Column:
    """The same name for a step and its reverse."""
    a, b = F.struct(F.col(f"{side}.f").alias("f"), (1 - F.col(f"{side}.in")).alias("e")), F.struct(F.col(f"{to}.f").alias("f"), F.col(f"{to}.in").alias("e"))
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
