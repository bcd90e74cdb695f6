"""What tracing needs of pixels, by blocks of images: ridge pixels of the distance map with their gradients, and runs of foreground.

A block sees its pixels and those around it, and is read as an array, so that pixels are sorted once instead of once for each window.
Whatever a block can't settle by itself it says: ridge pixels on which another block may decide are open, and a distance that may end
outside puts the image in doubt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiberlake.operators.pixels import kernel

#: Side of the blocks in which images are read, and how far a block sees beyond.
SIDE, BEYOND = 512, 40
#: What a row says: a ridge pixel (open: another block may decide on it, or it on another's; rim: at the image's rim), a run of foreground pixels from x to `to`, or that the image is in doubt.
RIDGE, RUN, DOUBT = 0, 1, 2
SAID = {"kind": T.IntegerType(), "x": T.IntegerType(), "y": T.IntegerType(), "to": T.IntegerType(), "distance": T.IntegerType(), "open": T.BooleanType(), "rim": T.BooleanType(), "xx": T.DoubleType(), "yy": T.DoubleType(), "xy": T.DoubleType()}


def blurred(gray: np.ndarray, weights: list[float]) -> np.ndarray:
    """pixels.gaussian_blur of an array: the same sums in the same order."""
    radius, v = len(weights) // 2, gray.astype(float)
    for axis in (1, 0):
        wide = np.pad(v, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], "edge")
        n, v = v.shape[axis], np.zeros(v.shape)
        for i, w in enumerate(weights):
            v += (wide[:, i : i + n] if axis else wide[i : i + n]) * w
    return np.floor(np.round(v, 9) + 0.5).astype(np.int64)


def distances(inside: np.ndarray) -> np.ndarray:
    """City-block distance to the nearest background pixel of the array; without any, more than its width and height."""
    d = np.where(inside, sum(inside.shape) + 1, 0)
    for axis in (0, 1):
        at = np.arange(d.shape[axis]).reshape((1, -1) if axis else (-1, 1))
        before = np.minimum.accumulate(d - at, axis) + at
        after = np.flip(np.minimum.accumulate(np.flip(d + at, axis), axis), axis) - at
        d = np.minimum(before, after)
    return d


def box_sums(v: np.ndarray, reach: int) -> np.ndarray:
    """Sums over windows of 2 reach + 1 pixels, as far as they are in the array."""
    for axis in (0, 1):
        sums, at = np.insert(np.cumsum(v, axis), 0, 0, axis), np.arange(v.shape[axis])
        v = np.take(sums, np.minimum(at + reach + 1, len(at)), axis) - np.take(sums, np.maximum(at - reach, 0), axis)
    return v


def gradients(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pixels.sobel of an array; none at its rim."""
    gx, gy = np.zeros_like(gray), np.zeros_like(gray)
    if min(gray.shape) > 2:
        smooth, step = gray[:-2] + 2 * gray[1:-1] + gray[2:], gray[2:] - gray[:-2]
        gx[1:-1, 1:-1] = smooth[:, 2:] - smooth[:, :-2]
        gy[1:-1, 1:-1] = step[:, :-2] + 2 * step[:, 1:-1] + step[:, 2:]
    return gx, gy


def thinned(x: np.ndarray, y: np.ndarray, d: np.ndarray, box: int, own: tuple[int, int, int, int], size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which ridge pixels of a block (own: left, top, right, bottom) stay, and which of these are open: tracing.spaced as far as a block can tell.

    From the first in rank on, a pixel stays unless one that stays is near; if one of which nobody knows yet is near, or one of another block may be, it is not known either.
    """
    left, top, right, bottom = own
    side = ((left > 0) & (x - left < box)) | ((top > 0) & (y - top < box)) | ((right < size[0]) & (x + box >= right)) | ((bottom < size[1]) & (y + box >= bottom))
    order = np.lexsort((x, y, -((x * 7_919 + y * 104_729) % 65_537), -d))
    taken, unknown = (np.zeros((bottom - top + 2 * box, right - left + 2 * box), bool) for _ in range(2))
    stays, is_open = [], []
    for i, at, up, near in zip(order.tolist(), (x[order] - left).tolist(), (y[order] - top).tolist(), side[order].tolist()):
        # the arrays have a margin of `box`
        if taken[up + box, at + box]:
            continue
        unsure = near or unknown[up + box, at + box]
        (unknown if unsure else taken)[up : up + 2 * box + 1, at : at + 2 * box + 1] = True
        stays.append(i)
        is_open.append(unsure)
    return np.array(stays, np.int64), np.array(is_open, bool)


def look(block: dict[str, np.ndarray], at: tuple[int, int], size: tuple[int, int], weights: list[float], least: float, box: int, window: int, side: int, beyond: int) -> dict[str, np.ndarray]:
    """The columns of SAID of one block. block: x, y, g, _limit of the pixels that it sees."""
    (left, top), (width, height) = (side * at[0], side * at[1]), size
    right, bottom = min(left + side, width), min(top + side, height)
    x0, y0, x1, y1 = max(left - beyond, 0), max(top - beyond, 0), min(right + beyond, width), min(bottom + beyond, height)
    gray, limit = np.zeros((y1 - y0, x1 - x0), np.float64 if block["g"].dtype.kind == "f" else np.int64), np.zeros((y1 - y0, x1 - x0))
    place = block["y"] - y0, block["x"] - x0
    gray[place], limit[place] = block["g"], block["_limit"]
    if len(weights) > 1:
        gray = blurred(gray, weights)
        # what is blurred with pixels that are not seen goes
        rim = len(weights) // 2
        cut = [rim if far else 0 for far in (x0 > 0, y0 > 0, x1 < width, y1 < height)]
        gray, limit = (v[cut[1] : y1 - y0 - cut[3], cut[0] : x1 - x0 - cut[2]] for v in (gray, limit))
        x0, y0, x1, y1 = x0 + cut[0], y0 + cut[1], x1 - cut[2], y1 - cut[3]
    inside = gray > limit
    d = distances(inside)
    xs, ys = np.arange(x0, x1).reshape(1, -1), np.arange(y0, y1).reshape(-1, 1)
    # the nearest pixel that is not seen
    unseen = np.full(d.shape, width + height + 2)
    for far, away in ((x0 > 0, xs - x0 + 1), (x1 < width, x1 - xs), (y0 > 0, ys - y0 + 1), (y1 < height, y1 - ys)):
        if far:
            unseen = np.minimum(unseen, away)
    own = slice(top - y0, bottom - y0), slice(left - x0, right - x0)
    grown = slice(max(top - 1, y0) - y0, bottom + 1 - y0), slice(max(left - 1, x0) - x0, right + 1 - x0)
    if (d > unseen)[grown].any():
        return {"kind": np.array([DOUBT])}
    around = np.pad(d, 1, constant_values=-1)
    n, m = d.shape
    most = np.max([around[i : i + n, j : j + m] for i in range(3) for j in range(3)], 0)
    tops = (d >= max(least, 0)) & (d == most) & (not inside.all())
    y, x = (v + o for v, o in zip(np.nonzero(tops[own]), (top, left)))
    stays, is_open = thinned(x, y, d[y - y0, x - x0], box, (left, top, right, bottom), size)
    x, y = x[stays], y[stays]
    gx, gy = gradients(gray)
    spot = y - y0, x - x0
    xx, yy, xy = (box_sums(p, window)[spot].astype(float) for p in (gx * gx, gy * gy, gx * gy)) if len(x) else (np.empty(0),) * 3
    edges = np.diff(np.pad(inside[own].astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, first), (_, last) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    rim_of = (x == 0) | (y == 0) | (x == width - 1) | (y == height - 1)
    none = np.zeros(len(row), np.int64)
    return {
        "kind": np.repeat([RIDGE, RUN], [len(x), len(row)]), "x": np.concatenate((x, first + left)), "y": np.concatenate((y, row + top)), "to": np.concatenate((x, last - 1 + left)),
        "distance": np.concatenate((d[spot], none)), "open": np.concatenate((is_open, none > 0)), "rim": np.concatenate((rim_of, none > 0)), **{k: np.concatenate((v, none)) for k, v in (("xx", xx), ("yy", yy), ("xy", xy))},
    }


def seen_by(beyond: int, side: int) -> Column:
    """The blocks that see a pixel."""
    of = lambda c, n: F.sequence(F.floor(F.greatest(F.col(c) - beyond, F.lit(0)) / side).cast("int"), F.floor(F.least(F.col(c) + beyond, F.col(n) - 1) / side).cast("int"))
    every = F.flatten(F.transform(of("y", "height"), lambda j: F.transform(of("x", "width"), lambda i: F.struct(i.alias("_bx"), j.alias("_by")))))
    return F.when((F.col("width") <= side) & (F.col("height") <= side), F.array(F.struct(F.lit(0).alias("_bx"), F.lit(0).alias("_by")))).otherwise(every)


def said(gray: DataFrame, sigma: float, least: float, box: int, window: int, side: int = SIDE) -> DataFrame:
    """image_id and SAID of dense grey images (image_id, x, y, g, width, height, _limit), blurred by sigma first. Ridge pixels are thinned to one within `box`, but for open ones."""
    weights = kernel(sigma) if sigma > 0.05 else [1.0]
    # a ridge pixel needs the distances beside it, its gradients a window and a pixel more
    beyond = max(BEYOND, len(weights) // 2 + window + 2)
    put = gray.select("image_id", "x", "y", "g", "_limit", "width", "height", F.explode(seen_by(beyond, side)).alias("_b")).select("image_id", "_b.*", "x", "y", "g", "_limit", "width", "height")

    def read(block: pa.Table) -> pa.Table:
        first = {c: block[c][0].as_py() for c in ("_bx", "_by", "width", "height")}
        columns = look({c: block[c].to_numpy() for c in ("x", "y", "g", "_limit")}, (first["_bx"], first["_by"]), (first["width"], first["height"]), weights, least, box, window, side, beyond)
        n = len(columns["kind"])
        image = block["image_id"].slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64)))
        kinds = {T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}
        return pa.table({"image_id": image, **{k: pa.array(columns[k].astype(kinds[t].to_pandas_dtype())) if k in columns else pa.nulls(n, kinds[t]) for k, t in SAID.items()}})

    kind = gray.select("image_id").schema["image_id"].dataType
    return put.groupBy("image_id", "_bx", "_by").applyInArrow(read, T.StructType([T.StructField("image_id", kind), *[T.StructField(k, t) for k, t in SAID.items()]]))
