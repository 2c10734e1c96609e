"""Online geocoders with an injected transport.

A transport is ``transport(url, params) -> dict`` (or raises). It is created in each
task by a factory, so sessions and keys never leave the workers; tests inject one
that answers from a table. Requests go out for distinct names only.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transport = Callable[[str, dict], dict]

FAULTS = "array<struct<tier:string,fault:string>>"
ONLINE = f"name string, lat double, lon double, tier string, faults {FAULTS}"


def _pair(lat, lon) -> tuple[float, float] | None:
    try:
        lat, lon = float(lat), float(lon)
    except (TypeError, ValueError):
        return None
    return (lat, lon) if abs(lat) <= 90 and abs(lon) <= 180 else None


def _lon_lat_text(body: dict):
    found = body.get("geocodes") or []
    if body.get("status") != "1" or not found:
        return None
    lon, _, lat = str(found[0].get("location", "")).partition(",")
    return _pair(lat, lon)


def _result_location(body: dict):
    at = (body.get("result") or {}).get("location") or {}
    return _pair(at.get("lat"), at.get("lng")) if body.get("status") == 0 else None


def _results_list(body: dict):
    found = body.get("results") or []
    return _pair(found[0].get("latitude") or None, found[0].get("longitude") or None) if found else None  # an exact 0 counts as missing there


def _features(body: dict):
    found = body.get("features") or []
    at = ((found[0].get("geometry") or {}).get("coordinates") or [None, None]) if found else [None, None]
    return _pair(at[1], at[0])


def _rows(body):
    return _pair(body[0].get("lat"), body[0].get("lon")) if isinstance(body, list) and body else None


#: The tiers in order: name, address, parameter of the name, and how an answer is read.
TIERS: list[tuple[str, str, str, Callable]] = [
    ("amap", "https://restapi.amap.com/v3/geocode/geo", "address", _lon_lat_text),
    ("tencent", "https://apis.map.qq.com/ws/geocoder/v1/", "address", _result_location),
    ("baidu", "https://api.map.baidu.com/geocoding/v3/", "address", _result_location),
    ("open-meteo", "https://geocoding-api.open-meteo.com/v1/search", "name", _results_list),
    ("photon", "https://photon.komoot.io/api/", "q", _features),
    ("nominatim", "https://nominatim.openstreetmap.org/search", "q", _rows),
]


def geocode_online(names: DataFrame, factory: Callable[[], Transport], enabled: tuple[str, ...] = tuple(t[0] for t in TIERS), interval: float = 0.0) -> DataFrame:
    """JN12, online tiers: ``(name, lat, lon, tier, faults)`` for distinct ``names(name, query_name)``.

    The first tier that answers wins; the free tiers ask for ``query_name`` first and
    then the name. Names that nobody knows have nulls. A tier that fails is passed
    over, and each fault is in ``faults`` with its tier. ``interval``: seconds between
    requests of one task.
    """

    def batches(source):
        import pandas as pd

        transport = factory()

        def ask(name: str, query: str):
            faults: list[dict] = []
            for tier, url, field, read in TIERS:
                if tier not in enabled:
                    continue
                for q in dict.fromkeys([query, name] if tier in ("open-meteo", "photon") else [name]):
                    if interval:
                        time.sleep(interval)
                    try:
                        found = read(transport(url, {field: q}))
                    except Exception as e:  # noqa: BLE001  whatever a transport raises is its tier's fault
                        found = None
                        faults.append({"tier": tier, "fault": f"{type(e).__name__}: {e}"})
                    if found:
                        return *found, tier, faults
            return None, None, None, faults

        for pdf in source:
            rows = [(n, *ask(n, q or n)) for n, q in zip(pdf["name"], pdf["query_name"], strict=True)]
            yield pd.DataFrame(rows, columns=["name", "lat", "lon", "tier", "faults"])

    distinct = names.groupBy("name").agg(F.min("query_name").alias("query_name"))
    return distinct.mapInPandas(batches, ONLINE)


def geocode(names: DataFrame, root: str, factory: Callable[[], Transport] | None, keywords: list[tuple[str, str]], translations: DataFrame, remember: bool = True, **online) -> DataFrame:
    """JN12-JN15 as one call: ``names(name)`` with ``lat``, ``lon``, ``tier`` and ``faults``.

    Dictionary, literal, then the online tiers for the distinct names still open,
    under their English names. What those find is added to the dictionary below
    ``root`` (see :mod:`places`), so the next run doesn't ask again. Every row is
    answered, nulls and repeats included; names are asked without quotes and space
    around them, and empty ones not at all. Answers are written before they are used.
    """
    from ..functions.text import unquoted
    from ..operators.spatial import english_names, geocoded
    from .places import add_places, places
    from .tables import materialised

    spark = names.sparkSession
    local = geocoded(names, places(spark, root))
    if factory is None:
        return local.withColumn("faults", F.array().cast(FAULTS))
    local = materialised(local.withColumn("_clean", unquoted(F.col("name"))))
    still = local.filter("tier is null and _clean != ''").select(F.col("_clean").alias("name")).distinct()
    found = materialised(geocode_online(english_names(still, keywords, translations).select("name", "query_name"), factory, **online))
    if remember and not found.filter("lat is not null").isEmpty():
        add_places(found, root)
    told = found.select(F.col("name").alias("_clean"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("tier").alias("_tier"), F.col("faults").alias("_faults"))
    out = local.join(told, "_clean", "left")
    return out.select(*names.columns, F.coalesce("lat", "_lat").alias("lat"), F.coalesce("lon", "_lon").alias("lon"), F.coalesce("tier", "_tier").alias("tier"), F.coalesce("_faults", F.array().cast(FAULTS)).alias("faults"))


def fault_counts(answers: DataFrame) -> DataFrame:
    """How often each tier failed, and how."""
    return answers.select(F.explode("faults").alias("_f")).groupBy(F.col("_f.tier").alias("tier"), F.col("_f.fault").alias("fault")).agg(F.count(F.lit(1)).alias("n"))
