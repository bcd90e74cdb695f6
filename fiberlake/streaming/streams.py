"""Regions arrive, fibres leave: Structured Streaming around the batch operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberlake.operators.rounds import unsent

TILE = ["image_id", "tile_id"]


def stream_detect(
    spark: SparkSession, source: str, schema, sink: str, checkpoint: str, detect: Callable[[DataFrame], DataFrame],
    postprocess: Callable[[DataFrame], DataFrame] | None = None, results: str | None = None, files: int | None = None,
):
    """Starts a query that analyses tile files as they arrive and stores each tile's fibres; a tile that comes again replaces itself.

    detect gets a batch of tile pixels and returns rows with image_id, tile_id and fiber_id. Ranking windows are not
    allowed on a stream, so it runs on each micro-batch (of that many files at most); a tile comes in one file. With
    postprocess, the images that a batch touched are post-processed again from all of their stored tiles into `results`.
    Both folders are logs by batch number: a batch that runs twice writes its own entry again, and once a log has COMPACT
    entries they become one. Read both folders by `stored`.
    """

    def batch(df: DataFrame, number: int) -> None:
        tiles = df.select(*TILE).distinct()
        _append(tiles.join(unsent(detect(df)), TILE, "left"), sink, TILE, number)
        if postprocess is not None:
            images = tiles.select("image_id").distinct()
            touched = stored(spark, sink).join(images, "image_id", "left_semi")
            _append(images.join(unsent(postprocess(touched)), "image_id", "left"), results, ["image_id"], number)

    rows = spark.readStream.schema(schema)
    if files is not None:
        rows = rows.option("maxFilesPerTrigger", files)
    return rows.parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Entries of a log before they are compacted.
COMPACT = 16


def _folders(spark: SparkSession, path: str) -> tuple[int, list[int], list[int]]:
    """(newest whole, older wholes, batches after the newest whole) of a log; entries whose write hasn't ended don't count."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    done = {"whole": [], "batch": []}
    for status in fs.listStatus(top) if fs.exists(top) else []:
        kind, _, number = status.getPath().getName().partition("=")
        if kind in done and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={number}/_SUCCESS")):
            done[kind].append(int(number))
    newest = max(done["whole"], default=-1)
    return newest, [n for n in done["whole"] if n < newest], sorted(n for n in done["batch"] if n > newest)


def _append(rows: DataFrame, path: str, keys: list[str], number: int) -> None:
    """The log's entry of a batch; each group of keys in it replaces what older entries have. Groups without fibres are one row without id."""
    rows.withColumn("_of", F.to_json(F.struct(*keys))).write.mode("overwrite").parquet(f"{path}/batch={number}")
    if len(_folders(rows.sparkSession, path)[2]) >= COMPACT:
        compact(rows.sparkSession, path)


def _latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest entry of each group."""
    whole, _, batches = _folders(spark, path)
    parts = [spark.read.parquet(f"{path}/batch={n}").withColumn("_entry", F.lit(n)) for n in batches]
    if whole >= 0:
        parts.append(spark.read.parquet(f"{path}/whole={whole}").withColumn("_entry", F.lit(-1)))
    every = reduce(DataFrame.unionByName, parts)
    newest = every.groupBy(F.col("_of").alias("_group")).agg(F.max("_entry").alias("_newest"))
    return every.join(newest, (F.col("_of") == F.col("_group")) & (F.col("_entry") == F.col("_newest"))).drop("_group", "_entry", "_newest")


def compact(spark: SparkSession, path: str) -> None:
    """Makes one entry of a log's newest rows. What it replaces goes with the next compaction, so that readers who have begun can end."""
    whole, older, batches = _folders(spark, path)
    if not batches:
        return
    _latest(spark, path).write.mode("overwrite").parquet(f"{path}/whole={batches[-1]}")
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(top):
        kind, _, number = status.getPath().getName().partition("=")
        if (kind == "batch" and int(number) <= whole) or (kind == "whole" and int(number) in older):
            fs.delete(status.getPath(), True)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The fibres that stream_detect stored: of each tile, or image, what the newest batch that has it wrote. Entries that are being written don't show in part."""
    return _latest(spark, path).where(F.col("fiber_id").isNotNull()).drop("_of")


def tile_health(stats: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Per window: tiles, failed tiles, mean and population deviation of traced fibres. Works on a stream (with watermark) and on a batch."""
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    s = stats.withWatermark("event_time", late) if stats.isStreaming else stats
    a = s.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("tiles"), F.sum(F.when(~F.col("ok"), 1).otherwise(0)).alias("failed"), F.avg("n_traced").alias("mean_traced"), F.stddev_pop("n_traced").alias("std_traced"))
    return a.select(F.col("w.start").alias("window_start"), "tiles", "failed", "mean_traced", "std_traced")


def latest_request_wins(requests: DataFrame) -> DataFrame:
    """The request of the highest generation of each region (region_id, generation, request); update mode on a stream, one state row a region."""
    return requests.groupBy("region_id").agg(F.max("generation").alias("generation"), F.max_by("request", "generation").alias("request"))
