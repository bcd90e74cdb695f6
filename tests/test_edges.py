"""Edges: hysteresis across blocks, held against a flood fill."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiberlake.operators import detect, pixels, rounds, tuning

EDGES = "image_id long, x int, y int, strong boolean"


def flooded(pixels):
    """{(image, x, y)} that strong pixels reach; pixels: {(image, x, y): strong}."""
    kept = {p for p, s in pixels.items() if s}
    todo = list(kept)
    while todo:
        i, x, y = todo.pop()
        for n in ((i, x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
            if n in pixels and n not in kept:
                kept.add(n)
                todo.append(n)
    return kept


def kept(spark, pixels):
    df = spark.createDataFrame([(*p, s) for p, s in pixels.items()], EDGES)
    rows = detect.hysteresis(df).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {(r.image_id, r.x, r.y) for r in rows}


@pytest.mark.parametrize("share,strong", [(0.2, 0.05), (0.41, 0.001), (0.6, 0.0005)])
def test_random_pixels(spark, share, strong):
    rng = random.Random(7)
    pixels = {(i, x, y): rng.random() < strong for i in (0, 3) for x in range(-20, 300) for y in range(240, 530) if rng.random() < share}
    assert kept(spark, pixels) == flooded(pixels)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A spiral of 30,000 weak pixels over many blocks, and a straight chain of 2,000; labels of blocks meet in at most 12 rounds."""
    turns = []
    monkeypatch.setattr(rounds.Rounds, "kept", lambda self, df, own=rounds.Rounds.kept: turns.append(1) or own(self, df))
    chain = {(0, 3 + k, 10 + k % 2): k == 1_999 for k in range(2_000)}
    spiral, x, y, dx, dy, leg = {}, 600, 600, 1, 0, 3
    while len(spiral) < 30_000:
        for _ in range(leg):
            spiral[1, x, y] = len(spiral) == 12
            x, y = x + dx, y + dy
        dx, dy, leg = -dy, dx, leg + 3
    alone = {(2, k, 5): False for k in range(700)}
    pixels = chain | spiral | alone
    assert kept(spark, pixels) == flooded(pixels) == set(chain) | set(spiral)
    assert 1 < len(turns) <= 12


def test_no_edges(spark):
    assert kept(spark, {(0, 1, 1): False}) == set()
    assert detect.hysteresis(spark.createDataFrame([], EDGES)).collect() == []


def test_components_of_paths_and_stars(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = list(zip(order[:100], order[1:100])) + [(order[150], k) for k in order[100:150]] + [(7, 7), (order[0], order[1])]
    got = {r.node: r.label for r in rounds.components(spark.createDataFrame(links, "a long, b long")).collect()}
    one, two = set(order[:100]), set(order[100:151])
    assert got == {k: min(one) for k in one} | {k: min(two) for k in two}


def test_parts_of_runs():
    rng = np.random.default_rng(2)
    for share in (0.1, 0.4, 0.7):
        grid = rng.random((40, 50)) < share
        grid[:, [0, -1]] = False
        places = np.flatnonzero(grid)
        first = detect.runs_joined(places, 50)
        label = dict(zip(places.tolist(), first.tolist()))
        for p in label:
            for q in (p + 1, p + 49, p + 50, p + 51):
                assert q not in label or label[q] == label[p]
        parts = {f: {p for p in label if label[p] == f} for f in set(label.values())}
        for f, members in parts.items():
            reached = todo = {f}
            while todo:
                todo = {q for p in todo for d in (1, 49, 50, 51) for q in (p + d, p - d) if q in members} - reached
                reached = reached | todo
            assert f == min(members) and reached == members


def noisy(spark, wide=530, high=270):
    """One grey image over several blocks: scattered values and a slanted bar that crosses block borders."""
    n = spark.range(wide * high).select(F.lit(1).cast("long").alias("image_id"), (F.col("id") % wide).cast("int").alias("x"), F.floor(F.col("id") / wide).cast("int").alias("y"))
    bar = F.abs(F.col("y") * 2 - F.col("x")) < 9
    return n.withColumn("g", F.when(bar, 200).otherwise(F.pmod(F.xxhash64("x", "y"), F.lit(60))).cast("int")).withColumn("width", F.lit(wide)).withColumn("height", F.lit(high))


def test_block_edges_at_many_settings_equal_windows_at_each(spark):
    gray = rounds.cut(noisy(spark))
    settings = [(None, 40, 120), (30.0, 40, 120), (90.0, 10, 900), (255.0, 40, 120)]
    got = detect.setting_edges(gray, ["image_id"], settings).select("setting", "x", "y").collect()
    for k, (level, low, high) in enumerate(settings):
        one = gray if level is None else gray.withColumn("g", F.when(F.col("g") > level, F.col("g")).otherwise(0))
        want = detect.hysteresis(pixels.thin_edges(one, low, high)).select("x", "y").collect()
        assert sorted((r.x, r.y) for r in got if r.setting == k) == sorted(map(tuple, want))
        assert len(want) > 500 or k == 3 and not want


def test_a_sweep_shuffles_pixels_once_and_equals_single_detections(spark):
    gray = rounds.cut(noisy(spark, 300, 160))
    exchanges = lambda n: detect.setting_parts(gray, [(float(i), 40, 120) for i in range(n)])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(1) == exchanges(60) == 1
    combos = spark.createDataFrame([(7, 90.0), (3, 30.0), (9, 90.0)], "combo_id int, level double")
    columns = ["fiber_id", "points", "angle", "length_arc"]
    got = tuning.sweep_lines(gray, ["image_id"], combos, least=40).select("combo_id", *columns).collect()
    for combo, level in ((7, 90.0), (3, 30.0), (9, 90.0)):
        one = detect.detect(gray.withColumn("g", F.when(F.col("g") > level, F.col("g")).otherwise(0)), ["image_id"], least=40).select(*columns).collect()
        assert one and sorted(map(str, one)) == sorted(str(r).replace(f"combo_id={combo}, ", "") for r in got if r.combo_id == combo)


def test_edges_of_nothing_of_no_combo_and_of_values_that_are_missing(spark):
    gray = rounds.cut(noisy(spark, 40, 30))
    assert detect.setting_edges(gray.where("false"), ["image_id"], [(None, 40, 120)]).collect() == []
    assert tuning.sweep_lines(gray, ["image_id"], spark.createDataFrame([], "combo_id int, level double")).collect() == []
    holes = gray.withColumn("g", F.when(F.col("x") % 11 != 5, F.col("g")))
    want = detect.hysteresis(pixels.thin_edges(holes)).collect()
    assert sorted(map(tuple, detect.edges(holes).select("image_id", "x", "y").collect())) == sorted((r.image_id, r.x, r.y) for r in want)
