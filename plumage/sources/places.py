"""The dictionary of places as a table of versions that several runs extend at once.

A version is a small file that names a folder of Parquet rows. A run writes its rows
first and then renames a file of its own into the list of versions, which is the
switch: readers see all of a version or nothing. Nothing is ever rewritten, and two
runs that count the same number have two files, so neither loses a name. Of a
name's values the oldest counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, lat double, lon double"


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the versions there are, in order: a number and what tells equal numbers apart."""
    at, system = _system(spark, f"{root}/versions")
    if not system.exists(at):
        return []
    names = [f.getPath().getName() for f in system.listStatus(at)]
    return sorted(n.removesuffix(".version") for n in names if n.endswith(".version"))


def places(spark: SparkSession, root: str, upto: str | None = None) -> DataFrame:
    """JN12, JN15: ``(name, lat, lon)``, one row a name, of all versions or those up to one."""
    known = [v for v in versions(spark, root) if upto is None or v <= upto]
    if not known:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(*[f"{root}/data/{v}" for v in known]).select("*", F.regexp_extract("_metadata.file_path", r"/data/([^/]+)/", 1).alias("version"))
    return rows.groupBy("name").agg(F.min_by(F.struct("lat", "lon"), F.struct("version", "lat", "lon")).alias("_at")).select("name", "_at.lat", "_at.lon")


def add_places(found: DataFrame, root: str) -> str:
    """JN15: the version that adds ``found(name, lat, lon)``; rows without a name or position are left out.

    Names that an older version has keep its values. A run that ends before the
    switch leaves rows that no version names.
    """
    spark = found.sparkSession
    last = max([int(v.split("-")[0]) for v in versions(spark, root)], default=0)
    version = f"{last + 1:08d}-{uuid.uuid4().hex}"
    found.select("name", "lat", "lon").filter("name is not null and lat is not null and lon is not null").write.parquet(f"{root}/data/{version}")
    begun, system = _system(spark, f"{root}/versions/{version}.begun")
    system.create(begun, False).close()
    if not system.rename(begun, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{version}.version")):
        raise OSError(f"version {version} could not be put in place")
    return version
