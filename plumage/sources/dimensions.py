"""Dimension tables from JSON and GeoJSON files, by explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def species_list(spark: SparkSession, path: str) -> DataFrame:
    """D14: ``(idx, cn, en, sci)`` of a list of names; places of rows that are no lists are skipped."""
    rows = _text(spark, path).select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "_v"))
    rows = rows.filter(F.col("_v").startswith("[")).withColumn("_n", F.from_json("_v", "array<string>"))
    part = lambda i: F.trim(F.coalesce(F.get("_n", F.lit(i)), F.lit("")))
    return rows.select("idx", part(0).alias("cn"), part(1).alias("en"), part(2).alias("sci"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """D13: one row a species, with its place in the file."""
    entry = "struct<order_cn:string,family_cn:string,genus_cn:string,name_la:string,genus_la:string>"
    rows = _text(spark, path).select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,{entry}>"))).alias("ord", "_e"))
    filled = lambda c, d: F.coalesce(F.nullif(F.col(f"_e.value.{c}"), F.lit("")), F.lit(d)).alias(c)
    return rows.select("ord", F.col("_e.key").alias("species_cn"), filled("order_cn", "未知目"), filled("family_cn", "未知科"), filled("genus_cn", "未知属"), filled("name_la", ""), filled("genus_la", ""))


def region_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """D12: ``region_species(ord, region_key, region_name, species_code)``, with the region's place in the file, and ``code_index(code, idx)``."""
    doc = _text(spark, path).select(F.from_json("value", "struct<code_mapping:map<string,int>,regions:map<string,struct<name:string,species:array<string>>>>").alias("_d")).select("_d.*")
    codes = doc.select(F.explode("code_mapping").alias("code", "idx"))
    regions = doc.select(F.posexplode(F.map_entries("regions")).alias("ord", "_r")).select("ord", F.col("_r.key").alias("region_key"), F.col("_r.value.name").alias("region_name"), F.explode("_r.value.species").alias("species_code"))
    return regions, codes


def polygons(spark: SparkSession, path: str, name_fields: tuple[str, ...] = ("name",)) -> DataFrame:
    """D11: ``(file, ord, name, part, ring)``: the outer rings of a feature collection.

    Holes and other geometries are left out. ``name_fields``: the first non-blank one.
    """
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    rows = _text(spark, path).select(F.input_file_name().alias("file"), F.posexplode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("ord", "_f"))
    name = F.coalesce(*[F.nullif(F.trim(F.col("_f.properties")[n]), F.lit("")) for n in name_fields])
    single = F.from_json("_f.geometry.coordinates", "array<array<array<double>>>")
    multi = F.from_json("_f.geometry.coordinates", "array<array<array<array<double>>>>")
    outer = F.when(F.col("_f.geometry.type") == "Polygon", F.array(F.get(single, F.lit(0)))).when(F.col("_f.geometry.type") == "MultiPolygon", F.transform(multi, lambda p: F.get(p, F.lit(0))))
    parts = rows.select("file", "ord", name.alias("name"), F.posexplode(outer).alias("part", "_ring")).filter("name is not null")
    return parts.select("file", "ord", "name", "part", F.transform("_ring", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("ring")).filter(F.size("ring") >= 3)


def named_points(spark: SparkSession, path: str) -> DataFrame:
    """``(name, lon, lat)`` of the points of a feature collection."""
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<double>>>"
    rows = _text(spark, path).select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f")).filter("f.geometry.type = 'Point'")
    return rows.select(F.col("f.properties")["name"].alias("name"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))
