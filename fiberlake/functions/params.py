"""Unit conversion, angle parameters and override maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fiberlake.functions.geometry import half_up

# Parameter names that live beside the tracer's own, and those that are whole numbers.
TOP_LEVEL = ("LL1", "widMAX", "coefficient_percentile", "num_scales", "fiber_threshold")
WHOLE = ("ang_interval", "s_xlinkbox", "s_fiberdir", "s_minstep", "s_maxstep", "num_scales", "thresh_LMPdist")


def calibrated(pixel_size: Column) -> Column:
    return F.coalesce((pixel_size > 0) & ~F.isnan(pixel_size) & (pixel_size < F.lit(float("inf"))), F.lit(False))


def to_analysed_px(value: Column, pixel_size: Column, downsample: Column) -> Column:
    return F.when(calibrated(pixel_size), value / pixel_size).otherwise(value) / downsample


def from_analysed_px(value: Column, pixel_size: Column, downsample: Column) -> Column:
    full = value * downsample
    return F.when(calibrated(pixel_size), full * pixel_size).otherwise(full)


def whole_at_least(least: int, value: Column) -> Column:
    return F.greatest(F.lit(least).cast("long"), half_up(value))


def bend_to_cos(degrees: Column) -> Column:
    return F.cos(F.radians(F.greatest(F.lit(0.0), F.least(F.lit(89.0), degrees))))


def cos_to_bend(c: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def link_to_cos(degrees: Column) -> Column:
    return -bend_to_cos(degrees)


def cos_to_link(c: Column) -> Column:
    return cos_to_bend(-c)


def native_to_threshold(t: Column, lo: Column, hi: Column) -> Column:
    """Native intensity on the 0-255 scale."""
    span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0), F.least(F.lit(255), half_up((t - lo) / span * 255.0))).cast("int")


def or_default(x: Column, default) -> Column:
    """A missing or zero value means the default."""
    return F.coalesce(F.nullif(x, F.lit(0).cast("double")), F.lit(default))


def merged(defaults: Column, *overrides: Column) -> Column:
    """map<string,string>: later maps win; null values never do."""
    parts = [F.map_entries(F.map_filter(m, lambda k, v: v.isNotNull())) for m in (defaults, *overrides)]
    pairs = F.flatten(F.array(*parts))
    keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def whole_numbers(params: Column) -> Column:
    """The whole-number parameters rounded half to even; values that are no numbers stay."""
    def fix(k: Column, v: Column) -> Column:
        number = v.try_cast("double")
        return F.when(k.isin(*WHOLE) & number.isNotNull(), F.bround(number).cast("long").cast("string")).otherwise(v)

    return F.transform_values(params, fix)
