"""Numeric column functions with the rounding of the carrier format: halves go up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..formats import POINT


def round_up(x: Column) -> Column:
    """To the next whole number from the half on, also below zero (-2.5 gives -2)."""
    return F.floor(x + 0.5)


def round_at(x: Column, places: int) -> Column:
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def is_pixels(bounds: Column) -> Column:
    """Bounds count as pixels where one of them is a whole number above 1."""
    sides = F.array(*[bounds[k].cast("double") for k in "xywh"])
    return F.exists(sides, lambda v: (v == F.floor(v)) & (v > 1))


def to_percent(bounds: Column, width: Column, height: Column) -> Column:
    """Pixel bounds as percentages of the image with 4 places; others as they are."""
    part = lambda k, size: F.when(is_pixels(bounds), round_at(100 * bounds[k] / size, 4)).otherwise(bounds[k]).cast("double").alias(k)
    return F.struct(part("x", width), part("y", height), part("w", width), part("h", height))


def share(value: Column, origin, size) -> Column:
    """Host geometry: percentage with 2 places."""
    return round_at(100 * (value - origin) / size, 2)


def canonical_height(width: Column, height: Column, to: int = 1024, least: int = 8) -> Column:
    """Height at canonical width, a multiple of 8."""
    return F.greatest(F.lit(least), (round_up(height / width * to / 8) * 8).cast("int"))


def font_percent(points: Column, height: Column) -> Column:
    """Font size as percentage text with 3 places; null without a size or height."""
    ok = (points > 0) & (height > 0)
    return F.when(ok, F.format_string("%.3f%%", round_at(points * POINT / height * 100, 3)))
