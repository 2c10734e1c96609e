"""Bounding-box arithmetic (PRJ2-PRJ6, FLT6, FLT15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def clamped(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, dx: Column, dy: Column) -> list[Column]:
    """The box grown by ``dx`` and ``dy`` on each side and cut at the frame."""
    return [F.greatest(F.lit(0), x1 - dx), F.greatest(F.lit(0), y1 - dy), F.least(width, x2 + dx), F.least(height, y2 + dy)]


def expanded(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, share: float) -> list[Column]:
    """PRJ3: grown by the truncated share of the longer side; the cut original if that is empty."""
    margin = F.floor(F.greatest(F.greatest(x2 - x1, F.lit(1)), F.greatest(y2 - y1, F.lit(1))) * F.lit(share)).cast("int")
    grown = clamped(x1, y1, x2, y2, width, height, margin, margin)
    plain = clamped(x1, y1, x2, y2, width, height, F.lit(0), F.lit(0))
    empty = (grown[2] <= grown[0]) | (grown[3] <= grown[1])
    return [F.when(empty, p).otherwise(g) for g, p in zip(grown, plain, strict=True)]


def padded(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pixels: int = 10) -> list[Column]:
    """PRJ4: grown by a fixed margin."""
    return clamped(x1, y1, x2, y2, width, height, F.lit(pixels), F.lit(pixels))


def by_axis(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, ratio: float = 1.0) -> list[Column]:
    """PRJ5: each axis grown by the truncated ratio of its own length."""
    return clamped(x1, y1, x2, y2, width, height, F.floor((x2 - x1) * F.lit(ratio)).cast("int"), F.floor((y2 - y1) * F.lit(ratio)).cast("int"))


def shifted(x1: Column, y1: Column, x2: Column, y2: Column, ox: Column, oy: Column) -> list[Column]:
    """PRJ6: from a crop's coordinates to the frame's."""
    return [x1 + ox, y1 + oy, x2 + ox, y2 + oy]


def holds(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, tolerance: float) -> Column:
    """FLT6: whether a point lies in the box widened by a share of its size, borders included."""
    tx, ty = (x2 - x1) * F.lit(tolerance), (y2 - y1) * F.lit(tolerance)
    return px.between(x1 - tx, x2 + tx) & py.between(y1 - ty, y2 + ty)


def non_empty(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """FLT15."""
    return (x2 > x1) & (y2 > y1)
