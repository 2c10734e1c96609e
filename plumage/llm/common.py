"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words is exactly these ASCII characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Ids that are sent to all executors rather than joined in a shuffle.
BROADCAST_ROWS = 500_000

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing and Spark runs in one process (tests), a
    temporary folder serves; on a cluster that is an error, because executors
    would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    global _local_root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = os.path.join(tempfile.gettempdir(), "checkpoints", f"plumage-{uuid.uuid4().hex}")
        atexit.register(shutil.rmtree, _local_root, True)
    return _local_root


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/plumage/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table that no later stage reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks that it ran, not the
    steps before the table. The size of the table is known to the planner, which
    broadcasts a join side only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def unwritten(df: DataFrame) -> None:
    """Delete a table made by :func:`written`."""
    path = getattr(df, "written_path", None)
    if path:
        delete_path(df.sparkSession, path)


def among(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose ``doc_id`` is in the only column of ``ids``, or isn't (``left_anti``).

    Few ids are sent to all executors, so that the rows' texts stay where they are;
    ``BROADCAST_ROWS`` longs are below 20 MB. More are joined in a shuffle.
    """
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, rows["doc_id"] == ids[ids.columns[0]], how)


def one_row_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have a doc_id, one for each.

    Of rows that share one, the one with the least text stays (null first), of
    equal texts the one with the least hash of its columns.
    """
    rows = docs.filter(F.col("doc_id").isNotNull())
    again = written(rows.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("again")), "repeated-ids")
    if again.isEmpty():
        unwritten(again)
        return rows
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    packed = among(rows, again).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.struct("text", F.xxhash64(*hashed)).alias("_order"), F.col("doc_id").alias("_id"))
    chosen = packed.groupBy("_id").agg(F.min_by("_row", "_order").alias("_row"))
    return among(rows, again, "left_anti").unionByName(chosen.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))


def words_of(text: Column) -> Column:
    """Words as ``[^\\x20\\x09-\\x0D]+``; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf8_bytes(text: Column) -> Column:
    """Length of the text in UTF-8 bytes; null: 0."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the ``documents`` table."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
