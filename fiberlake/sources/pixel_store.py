"""Pixels by blocks and levels, so that a region reads little: rows lie in the Morton order of their blocks, and a region becomes a few ranges of keys that reach the scan as filters."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Boxes that one read takes at most: they are parameters, and become part of the plan.
MOST_BOXES = 1_000
#: Ranges of keys for each box; the smallest gaps between ranges are read as well where there are more.
MOST_RANGES = 16
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def morton(x: Column, y: Column) -> Column:
    """The bits of x and y (whole, 0 to 2^31 - 1) in turn, x lowest."""
    def spread(v: Column) -> Column:
        v = v.cast("long")
        for by, mask in _SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def key_ranges(x0: int, y0: int, x1: int, y1: int, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of Morton keys, ends included, that hold all blocks x0 to x1, y0 to y1 (ends included), `most` at most.

    Squares that lie across the box's border are parted until they are a thirty-second of its longer side; a range may so hold other blocks too.
    """
    side = 1 << max(x1, y1).bit_length()
    least = max(1, (max(x1 - x0, y1 - y0) + 1) // 32)
    found: list[list[int]] = []
    todo = [(0, 0, side, 0)]
    while todo:
        x, y, n, key = todo.pop()
        if x > x1 or y > y1 or x + n <= x0 or y + n <= y0:
            continue
        if n <= least or (x >= x0 and y >= y0 and x + n - 1 <= x1 and y + n - 1 <= y1):
            if found and found[-1][1] + 1 == key:
                found[-1][1] = key + n * n - 1
            else:
                found.append([key, key + n * n - 1])
            continue
        h = n // 2
        # the last one is looked at first
        todo += [(x + h, y + h, h, key + 3 * h * h), (x, y + h, h, key + 2 * h * h), (x + h, y, h, key + h * h), (x, y, h, key)]
    gaps = sorted(range(1, len(found)), key=lambda i: found[i][0] - found[i - 1][1])
    closed = set(gaps[: max(0, len(found) - most)])
    out: list[tuple[int, int]] = []
    for i, (lo, hi) in enumerate(found):
        if i in closed:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


@dataclass(frozen=True)
class PixelStore:
    """A folder of pixels at levels 0 to `levels`; a cell of level k is the sum and number of the values of 2^k x 2^k pixels.

    Columns: image_id, channel, code (Morton key of the block of block x block cells), x, y (of the cell), total, n; one folder a level.
    """

    path: str
    levels: int = 5
    block: int = 64
    page_rows: int = 20_000

    def _at(self, level: int) -> str:
        return f"{self.path}/level={level}"

    def write(self, px: DataFrame) -> None:
        """px: image_id, channel, x, y (0 or more), value. Each level is made of the one before, with a quarter of its rows; null values count for nothing."""
        spark = px.sparkSession
        cells = px.select("image_id", "channel", "x", "y", F.col("value").alias("total"), F.when(F.col("value").isNull(), 0).otherwise(1).cast("long").alias("n"))
        for level in range(self.levels + 1):
            if level:
                half = [F.shiftright(c, 1).alias(c) for c in ("x", "y")]
                cells = spark.read.parquet(self._at(level - 1)).groupBy("image_id", "channel", *half).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
            code = morton(F.floor(F.col("x") / F.lit(self.block)), F.floor(F.col("y") / F.lit(self.block)))
            # the place is part of the order, so that a crowded block or image is cut as well
            order = ["image_id", "channel", "code", "y", "x"]
            ordered = cells.withColumn("code", code).repartitionByRange(*order).sortWithinPartitions(*order)
            ordered.select("image_id", "channel", "code", "x", "y", "total", "n").write.option("parquet.page.row.count.limit", self.page_rows).parquet(self._at(level))

    def level_for(self, boxes: list[tuple], d: float) -> int:
        """The coarsest level from which means over d x d pixels inside the boxes are exact: its cells fit into theirs and into the boxes."""
        corners = [v for _, x, y, w, h in boxes if w is not None for v in (math.floor(x), math.floor(y), math.ceil(x + w), math.ceil(y + h))]
        fits = [k for k in range(self.levels + 1) if k == 0 or d % (1 << k) == 0 and all(v % (1 << k) == 0 for v in corners)]
        return max(fits)

    def read(self, spark: SparkSession, boxes: list[tuple], d: float = 1.0, channel: int | None = None) -> DataFrame:
        """image_id, channel, x, y, value of the pixels inside any of the boxes, or with d > 1 the means of cells of d x d pixels, as crop and downsample give them.

        boxes: (image_id, x, y, width, height) in pixels, origin floored, far side ceiled; image_id None: every image; width None: the whole
        image. At most MOST_BOXES, or an error; no box gives no row. A pixel in several boxes is read once.
        """
        if len(boxes) > MOST_BOXES:
            raise ValueError(f"more than {MOST_BOXES} boxes")
        level = self.level_for(boxes, d)
        cells = spark.read.parquet(self._at(level)).where(reduce(Column.__or__, [self._inside(b, level) for b in boxes], F.lit(False)))
        if channel is not None:
            cells = cells.where(F.col("channel") == channel)
        step = d / (1 << level)
        if step == 1:
            return cells.select("image_id", "channel", "x", "y", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("value"))
        cell = [F.floor(F.col(c) / F.lit(float(step))).cast("int").alias(c) for c in ("x", "y")]
        sums = cells.groupBy("image_id", "channel", *cell).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        return sums.select("image_id", "channel", "x", "y", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("value"))

    def _inside(self, box: tuple, level: int) -> Column:
        image, x, y, w, h = box
        its = F.lit(True) if image is None else F.col("image_id") == image
        if w is None:
            return its
        x0, y0, x1, y1 = (v >> level for v in (max(0, math.floor(x)), max(0, math.floor(y)), math.ceil(x + w), math.ceil(y + h)))
        if x1 <= x0 or y1 <= y0:
            return F.lit(False)
        ranges = key_ranges(x0 // self.block, y0 // self.block, (x1 - 1) // self.block, (y1 - 1) // self.block)
        keys = reduce(Column.__or__, [(F.col("code") >= lo) & (F.col("code") <= hi) for lo, hi in ranges])
        return its & keys & (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
