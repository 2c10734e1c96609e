"""Coordinates: conversions, checks, and a ray-casting predicate, all as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The box in which the map offset applies, and its ellipsoid.
OFFSET_BOX = (72.004, 137.8347, 0.8293, 55.8271)
SEMI_MAJOR = 6378245.0
ECCENTRICITY_SQUARED = 0.00669342162296594323


def valid(lat: Column, lon: Column) -> Column:
    """FLT11."""
    return lat.between(-90, 90) & lon.between(-180, 180)


def in_offset_box(lat: Column, lon: Column) -> Column:
    """FLT16."""
    west, east, south, north = OFFSET_BOX
    return lon.between(west, east) & lat.between(south, north)


def _waves(x: Column, *terms: tuple[float, float]) -> Column:
    total = None
    for weight, period in terms:
        wave = weight * F.sin(x * (math.pi / period))
        total = wave if total is None else total + wave
    return total * (2.0 / 3.0)


def gcj02(lat: Column, lon: Column) -> tuple[Column, Column]:
    """WGS84 to GCJ-02 (MTH3); the identity outside the box."""
    x, y = lon - 105.0, lat - 35.0
    root = F.sqrt(F.abs(x))
    north = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root + _waves(x, (20.0, 1 / 6), (20.0, 1 / 2)) + _waves(y, (20.0, 1), (40.0, 3)) + _waves(y, (160.0, 12), (320.0, 30))
    east = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root + _waves(x, (20.0, 1 / 6), (20.0, 1 / 2)) + _waves(x, (20.0, 1), (40.0, 3)) + _waves(x, (150.0, 12), (300.0, 30))
    phi = F.radians(lat)
    magic = 1.0 - ECCENTRICITY_SQUARED * F.sin(phi) * F.sin(phi)
    dlat = north * 180.0 / (SEMI_MAJOR * (1 - ECCENTRICITY_SQUARED) / (magic * F.sqrt(magic)) * math.pi)
    dlon = east * 180.0 / (SEMI_MAJOR / F.sqrt(magic) * F.cos(phi) * math.pi)
    inside = in_offset_box(lat, lon)
    return F.when(inside, lat + dlat).otherwise(lat), F.when(inside, lon + dlon).otherwise(lon)


def to_dms(value: Column) -> Column:
    """Decimal degrees as three rationals (MTH1): all parts truncated, sign dropped."""
    v = F.abs(value)
    d = F.floor(v)
    m = F.floor((v - d) * 60)
    s = F.floor(((v - d) * 60 - m) * 60 * 100)
    ratio = lambda n, den: F.struct(n.cast("int").alias("num"), F.lit(den).alias("den"))
    return F.array(ratio(d, 1), ratio(m, 1), ratio(s, 100))


def from_dms(dms: Column, ref: Column) -> Column:
    """Three rationals and a reference letter as decimal degrees (MTH2).

    A missing part and a zero denominator count as 0; S and W are negative.
    """
    part = lambda i: F.coalesce(F.get(dms, F.lit(i))["num"] / F.nullif(F.get(dms, F.lit(i))["den"], F.lit(0)), F.lit(0.0))
    total = part(0) + part(1) / 60.0 + part(2) / 3600.0
    letter = F.upper(F.substring(F.trim(F.coalesce(ref, F.lit("N"))), 1, 1))
    return F.when(letter.isin("S", "W"), -total).otherwise(total)


def literal_point(text: Column) -> Column:
    """``"lat,lon"`` as a struct of doubles, null if it isn't one (STR14)."""
    parts = F.split(text, ",")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    lat, lon = number(0), number(1)
    return F.when(valid(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point is in an outer ring ``array<struct<x, y>>`` (JN5), by ray casting.

    Left and lower edges are inside, right and upper ones are not.
    """
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.when(i == 0, n - 1).otherwise(i - 1))
        return ((a["y"] > lat) != (b["y"] > lat)) & (lon < (b["x"] - a["x"]) * (lat - a["y"]) / (b["y"] - a["y"] + F.lit(1e-15)) + a["x"])

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(False), lambda acc, i: acc != F.coalesce(crosses(i), F.lit(False)))
