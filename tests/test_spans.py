"""Spans against sets of pixels."""

import random

from fiberlake.operators import spans

SPANS = "image_id long, y int, x0 int, x1 int"


def cells(rows):
    return {(i, x, y) for i, y, x0, x1 in rows for x in range(x0, x1 + 1)}


def test_sweeps_equal_sets_of_pixels(spark):
    rnd = random.Random(4)
    make = lambda n: [(rnd.randrange(2), rnd.randrange(4), x, x + rnd.randrange(-2, 9)) for x in (rnd.randrange(40) for _ in range(n))]
    a, b = make(60), make(25) + [(7, 0, 3, 3), (7, 0, 3, 3)]
    da, db = spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS)
    for got, want in ((spans.union(da), cells(a)), (spans.intersection(da, db), cells(a) & cells(b)), (spans.difference(da, db), cells(a) - cells(b)), (spans.difference(db, da), cells(b) - cells(a))):
        rows = [(r.image_id, r.y, r.x0, r.x1) for r in got.collect()]
        assert cells(rows) == want and sum(x1 - x0 + 1 for _, _, x0, x1 in rows) == len(want)
        # no two spans touch
        assert len(rows) == sum((i, x - 1, y) not in want for i, x, y in want)
    pixels = spans.pixels_of(da)
    assert sorted((r.image_id, r.x, r.y) for r in pixels.collect()) == sorted(cells(a))
    assert {tuple(r) for r in spans.runs(pixels.union(pixels)).select("image_id", "y", "x0", "x1").collect()} == {tuple(r) for r in spans.union(da).select("image_id", "y", "x0", "x1").collect()}
    marked = spans.inside(pixels, db).collect()
    assert len(marked) == len(cells(a)) and all(r.inside == ((r.image_id, r.x, r.y) in cells(b)) for r in marked)
    share = {r.image_id: (r.foreground, r.covered) for r in spans.coverage(da, db).collect()}
    assert share == {i: (len({c for c in cells(a) if c[0] == i}), len({c for c in cells(a) & cells(b) if c[0] == i})) for i in (0, 1)}


def test_empty_spans(spark):
    none, some = spark.createDataFrame([], SPANS), spark.createDataFrame([(1, 0, 2, 5)], SPANS)
    assert spans.union(none).collect() == spans.intersection(none, some).collect() == spans.areas(none).collect() == []
    assert [(r.x0, r.x1) for r in spans.difference(some, none).collect()] == [(2, 5)]
    assert [(r.foreground, r.covered) for r in spans.coverage(some, none).collect()] == [(4, 0)]
    assert [r.inside for r in spans.inside(spans.pixels_of(some), none).collect()] == [False] * 4
