"""Regions of points: polygons, nested regions, attempts, and forward geocoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import gcj02, in_ring, literal_point
from ..functions.text import unquoted

#: Degrees of the grid that points and polygons meet on.
CELL = 2.0


def with_boxes(regions: DataFrame) -> DataFrame:
    """Bounding boxes of rings: ``minx, maxx, miny, maxy``."""
    side = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    return regions.withColumns({"minx": side(F.array_min, "x"), "maxx": side(F.array_max, "x"), "miny": side(F.array_min, "y"), "maxy": side(F.array_max, "y")})


def located(points: DataFrame, regions: DataFrame, key: list[str], within: str | None = None) -> DataFrame:
    """JN5, JN6: the first region (by ``ord``) whose outer ring holds a point.

    ``points(key..., lon, lat)``, ``regions(ord, name, ring)``; adds ``region`` (null
    if none). With ``within``, only regions whose ``parent`` equals that column of the
    points count. Points and boxes meet by equality of a grid cell, so this is a hash
    join whatever the number of regions; the ring test follows.
    """
    cell = lambda c: F.floor(c / CELL).cast("int")
    boxed = with_boxes(regions.filter(F.size("ring") >= 3))
    spread = boxed.withColumn("gx", F.explode(F.sequence(cell(F.col("minx")), cell(F.col("maxx"))))).withColumn("gy", F.explode(F.sequence(cell(F.col("miny")), cell(F.col("maxy")))))
    at = points.withColumns({"gx": cell(F.col("lon")), "gy": cell(F.col("lat"))})
    on = ["gx", "gy"]
    joined = at.join(spread.withColumnRenamed("parent", within), [*on, within]) if within else at.join(spread, on)
    hit = joined.filter(F.col("lon").between(F.col("minx"), F.col("maxx")) & F.col("lat").between(F.col("miny"), F.col("maxy")) & in_ring(F.col("lon"), F.col("lat"), F.col("ring")))
    first = hit.groupBy(*key).agg(F.min_by("name", "ord").alias("region"))
    return points.join(first, key, "left")


def attempts(points: DataFrame) -> DataFrame:
    """JN7: three readings of each point: as given, with the map offset, with axes swapped."""
    off_lat, off_lon = gcj02(F.col("lat"), F.col("lon"))
    reading = lambda n, lat, lon: F.struct(F.lit(n).alias("attempt"), lat.alias("lat"), lon.alias("lon"))
    tries = F.array(reading(0, F.col("lat"), F.col("lon")), reading(1, off_lat, off_lon), reading(2, F.col("lon"), F.col("lat")))
    return points.drop("_t").withColumn("_t", F.explode(tries)).select(*[c for c in points.columns if c not in ("lat", "lon")], "_t.attempt", "_t.lat", "_t.lon")


def location_meta(points: DataFrame, provinces: DataFrame, cities: DataFrame, key: str) -> DataFrame:
    """JN7: province, city and status (ok, no_coords, no_match) of each point.

    The first attempt that lies in a province decides; its city may be missing.
    """
    placed = located(attempts(points.filter("lat is not null and lon is not null")), provinces, [key, "attempt"]).filter("region is not null")
    best = placed.groupBy(key).agg(F.min_by(F.struct("lon", "lat", F.col("region").alias("province")), "attempt").alias("_b")).select(key, "_b.*")
    city = located(best, cities, [key], within="province").select(key, "province", F.col("region").alias("city"))
    out = points.join(city, key, "left")
    return out.withColumn("status", F.when(F.col("lat").isNull() | F.col("lon").isNull(), "no_coords").when(F.col("province").isNull(), "no_match").otherwise("ok"))


def with_override(df: DataFrame, province: str | None, city: str | None) -> DataFrame:
    """JN8: a given province and city where the coordinates gave no province."""
    found = F.col("province").isNotNull()
    return df.withColumn("city", F.when(found, F.col("city")).otherwise(F.lit(city))).withColumn("province", F.coalesce("province", F.lit(province)))


def geocoded(names: DataFrame, places: DataFrame) -> DataFrame:
    """JN12, local tiers: ``lat``, ``lon`` and ``tier`` of ``names(name)``: dictionary, then literal.

    Names that stay null are for the online tiers, see ``sources.geocoders``.
    """
    clean = unquoted(F.col("name"))
    known = places.select(F.col("name").alias("_place"), F.struct("lat", "lon").alias("_at"))
    df = names.withColumn("_clean", clean).join(known, F.col("_clean") == F.col("_place"), "left").withColumn("_lit", literal_point(F.col("_clean")))
    at = F.coalesce("_at", "_lit")
    tier = F.when(F.col("_at").isNotNull(), "dictionary").when(F.col("_lit").isNotNull(), "literal")
    return df.withColumns({"lat": at["lat"], "lon": at["lon"], "tier": tier}).drop("_clean", "_place", "_at", "_lit")


def english_names(names: DataFrame, keywords: list[tuple[str, str]], translations: DataFrame) -> DataFrame:
    """JN13, JN14: a translation of the whole name, else of the first keyword in it, else the name.

    The keywords are a literal list, so the search is an expression, not a join.
    """
    found = F.lit(None).cast("string")
    for word, english in reversed(keywords):
        found = F.when(F.col("name").contains(word), F.lit(english)).otherwise(found)
    table = translations.select(F.col("zh").alias("_zh"), F.col("en").alias("_en"))
    df = names.join(table, F.col("name") == F.col("_zh"), "left").withColumn("keyword_en", found)
    return df.withColumn("query_name", F.coalesce("_en", "name")).drop("_zh", "_en")


def remembered(places: DataFrame, found: DataFrame) -> DataFrame:
    """JN15: places with those found that they lack; the dictionary's own values stay."""
    new = found.filter("lat is not null and lon is not null").select("name", "lat", "lon").dropDuplicates(["name"])
    return places.select("name", "lat", "lon").unionByName(new.join(places.select("name"), "name", "left_anti"))
