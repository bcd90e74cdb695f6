"""Streams end like batches."""

from pyspark.sql import functions as F

from fiberlake.operators import detect, fibers
from fiberlake.streaming import streams

PIXELS = "image_id long, tile_id int, x int, y int, g int"


def line(tile, y):
    return [(0, tile, x, y, 200) for x in range(5, 60)]


def test_tiles_arrive_late_and_again(spark, tmp_path):
    src, sink, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    find = lambda df: detect.detect(df.select("image_id", "tile_id", "x", "y", "g"), ["image_id", "tile_id"], edge=False)

    def arrive(rows):
        spark.createDataFrame(rows, PIXELS).coalesce(1).write.mode("append").parquet(src)
        streams.stream_detect(spark, src, PIXELS, sink, state, find).awaitTermination()

    arrive(line(0, 10) + line(1, 20))
    assert {r.tile_id for r in streams.stored(spark, sink).collect()} == {0, 1}
    arrive(line(2, 30))
    arrive(line(1, 40))  # tile 1 again: it replaces itself
    got = sorted((r.tile_id, r.points[0].y) for r in streams.stored(spark, sink).collect())
    want = sorted((r.tile_id, r.points[0].y) for r in find(spark.createDataFrame(line(0, 10) + line(1, 40) + line(2, 30), PIXELS)).collect())
    assert got == want and {(0, 10), (1, 40), (2, 30)} <= set(got) and (1, 20) not in got


def test_touched_images_are_post_processed_again(spark, tmp_path):
    src, sink, out, state = (f"{tmp_path}/{n}" for n in ("in", "tiles", "images", "state"))
    find = lambda df: detect.detect(df.where("g > 0").select("image_id", "tile_id", "x", "y"), ["image_id", "tile_id"], edge=False)

    def arrive(rows):
        spark.createDataFrame(rows, PIXELS).repartition(3, "tile_id").write.mode("append").parquet(src)
        streams.stream_detect(spark, src, PIXELS, sink, state, find, fibers.renumber, out, files=1).awaitTermination()
        return sorted((r.image_id, r.tile_id, r.new_id) for r in streams.stored(spark, out).select("image_id", "tile_id", "new_id").collect())

    ids = lambda got: [(i, t) for i, t, _ in got]
    first = arrive(line(0, 10) + line(2, 30) + [(5, 0, x, 9, 200) for x in range(5, 60)])
    assert set(ids(first)) == {(0, 0), (0, 2), (5, 0)}
    late = arrive(line(1, 20))  # a late tile moves the ids of the next one
    assert set(ids(late)) == {(0, 0), (0, 1), (0, 2), (5, 0)}
    for image in (0, 5):
        assert [n for i, _, n in late if i == image] == list(range(len([0 for i, _, _ in late if i == image])))
    # tile 0 comes again without any line, then the other image too: what was stored goes
    gone = arrive([(0, 0, x, 10, 0) for x in range(5)])
    assert set(ids(gone)) == {(0, 1), (0, 2), (5, 0)}
    assert set(ids(arrive([(5, 0, 1, 1, 0)]))) == {(0, 1), (0, 2)}


def test_log_of_tiles(spark, tmp_path):
    """A batch that runs again changes nothing, an entry that is being written doesn't show, compaction keeps the newest rows."""
    top = f"{tmp_path}/log"
    rows = lambda *r: spark.createDataFrame(r, "image_id long, tile_id int, fiber_id long")
    seen = lambda: sorted(tuple(r) for r in streams.stored(spark, top).collect())
    streams._append(rows((0, 0, 1), (0, 1, 1), (0, 1, 2)), top, streams.TILE, 0)
    streams._append(rows((0, 1, 7), (3, 0, None)), top, streams.TILE, 1)
    want = [(0, 0, 1), (0, 1, 7)]
    assert seen() == want
    streams._append(rows((0, 1, 7), (3, 0, None)), top, streams.TILE, 1)
    assert seen() == want
    streams._append(rows((0, 0, 99)), top, streams.TILE, 2)
    (tmp_path / "log" / "batch=2" / "_SUCCESS").unlink()
    assert seen() == want
    streams._append(rows((0, 0, 5), (3, 0, 4)), top, streams.TILE, 2)
    want = [(0, 0, 5), (0, 1, 7), (3, 0, 4)]
    streams.compact(spark, top)
    assert seen() == want
    streams._append(rows((0, 0, None)), top, streams.TILE, 3)
    streams.compact(spark, top)
    assert seen() == want[1:]
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["batch=3", "whole=2", "whole=3"]


def test_a_late_window_is_dropped_behind_the_watermark(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = "event_time timestamp, ok boolean, n_traced int"

    def arrive(*minutes):
        spark.createDataFrame([(m,) for m in minutes], "m int").selectExpr("timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) as event_time", "true as ok", "m as n_traced").coalesce(1).write.mode("append").parquet(src)
        h = streams.tile_health(spark.readStream.schema(schema).parquet(src))
        h.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.window_start.hour, r.tiles) for r in spark.read.schema("window_start timestamp, tiles long").parquet(out).collect())

    arrive(10, 20, 65)
    arrive(50)  # late, but its window is still open
    assert arrive(75) == [(0, 3)]  # the watermark passed the first window
    assert arrive(30, 140) == [(0, 3), (1, 2)]  # too late: not counted, and nothing written twice


def test_latest_request_wins_in_any_order(spark):
    rows = [(1, 5, "b"), (1, 3, "a"), (2, 1, "x"), (1, 9, "c"), (1, 4, "d")]
    df = spark.createDataFrame(rows, "region_id long, generation long, request string").repartition(3)
    assert {r.region_id: r.request for r in streams.latest_request_wins(df).collect()} == {1: "c", 2: "x"}


def test_late_health_rows_are_counted_by_window(spark):
    df = spark.sql("select timestamp'2026-01-01 00:10:00' + make_interval(0,0,0,0,0,0,id * 600) event_time, id % 4 <> 0 ok, cast(id as int) n_traced from range(12)")
    h = streams.tile_health(df).orderBy("window_start").collect()
    assert [(r.tiles, r.failed) for r in h] == [(5, 2), (6, 1), (1, 0)]
    assert streams.tile_health(df, slide="30 minutes").select(F.sum("tiles")).first()[0] == 24
