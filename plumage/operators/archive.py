"""Archive plans: species groups, crop boxes, directories, file names, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import non_empty
from ..functions.text import padded_number, safe_name


def filled(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def species_key(sci: Column, cn: Column, root: Column, tag: Column) -> Column:
    """PRJ9: what groups the boxes of an image; ``root`` is null for birds."""
    other = F.concat(F.lit("__nb__|"), F.trim(root), F.lit("|"), F.trim(filled(tag, "未分类")))
    return F.when(root.isNotNull(), other).otherwise(F.coalesce(F.nullif(F.trim(sci), F.lit("")), F.nullif(cn, F.lit("")), F.lit("未知物种")))


def union_boxes(boxes: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """AGG6: the smallest box around all of a group, cut at the frame; empty ones go.

    ``keep`` names columns taken from the group's first box (by ``det``).
    """
    first = [F.min_by(c, "det").alias(c) for c in keep or []]
    df = boxes.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("width").alias("width"), F.max("height").alias("height"), F.count(F.lit(1)).alias("boxes"), *first)
    df = df.withColumns({"x1": F.greatest("x1", F.lit(0)), "y1": F.greatest("y1", F.lit(0)), "x2": F.least("x2", "width"), "y2": F.least("y2", "height")})
    return df.filter(non_empty(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))


def best_candidate(candidates: DataFrame, keep: list[str]) -> DataFrame:
    """AGG7: the surest candidate of each image; the first (det, rank) of equals."""
    order = F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("det"), -F.col("rank"))
    return candidates.groupBy("image").agg(F.max_by(F.struct("confidence", *keep), order).alias("_b")).select("image", "_b.*")


def directories(df: DataFrame) -> DataFrame:
    """PRJ8: ``directory``: four ranks for birds, two for other subjects (``other``)."""
    ranks = [safe_name(filled(F.col(c), d)) for c, d in (("order_cn", "未知目"), ("family_cn", "未知科"), ("genus_cn", "未知属"), ("species_cn", "未知"))]
    return df.withColumn("directory", F.when(F.col("other"), F.concat_ws("/", *ranks[:2])).otherwise(F.concat_ws("/", *ranks)))


def crop_names(df: DataFrame) -> DataFrame:
    """PRJ8: ``filename`` of a crop: ranks, place, number."""
    place = [F.when(F.coalesce(F.col(c), F.lit("")) != "", safe_name(F.col(c))).otherwise(d) for c, d in (("province", "未知省"), ("city", "未知市"))]
    return directories(df).withColumn("filename", F.concat(F.concat_ws("_", F.replace("directory", F.lit("/"), F.lit("_")), *place, padded_number(F.col("seq"))), F.lit(".jpg")))


def copy_names(df: DataFrame) -> DataFrame:
    """SNK6: ``filename`` of a copied original: its stem, place, number and suffix."""
    place = [F.when(F.coalesce(F.col(c), F.lit("")) != "", safe_name(F.col(c))).otherwise(d) for c, d in (("province", "未知省"), ("city", "未知市"))]
    base = F.regexp_extract("path", r"([^/\\]*)$", 1)
    ext = F.regexp_extract(base, r"[^.](\.[^.]*)$", 1)
    stem = F.when(ext == "", base).otherwise(F.expr("left(_base, length(_base) - length(_ext))"))
    df = df.withColumns({"_base": base, "_ext": ext}).withColumn("_stem", stem)
    return df.withColumn("filename", F.concat(F.concat_ws("_", safe_name(F.col("_stem")), *place, padded_number(F.col("seq"))), filled(F.col("_ext"), ".jpg"))).drop("_base", "_ext", "_stem")


def numbered(df: DataFrame, order: list[str], slices: int = 64) -> DataFrame:
    """WIN8: ``seq`` from 1 in the total order of ``order``, without sorting everything in one task.

    Rows are range-partitioned by the order and written cut. Each slice is numbered by
    itself, and the counts of the slices before it, ``slices`` rows in all however many
    rows there are, give its offset.
    """
    from ..sources.tables import materialised

    cut = materialised(df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")).select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_slice").orderBy(*order)
    return cut.join(F.broadcast(starts), "_slice").withColumn("seq", F.col("_start") + F.row_number().over(inside)).drop("_slice", "_start")  # a row a slice


def collision_names(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """WIN7: ``target`` names of files in one folder: repeats get ``_1``, ``_2`` and so on.

    ``files(path, stem, ext)``, in the order of ``path``; ``existing(stem, ext)`` are names
    that the folder has already. The first file of a name keeps it unless the folder
    has it; the others take the least numbers whose names no file has, so all targets
    differ from each other and from what is there. A number is free for the ``k``-th
    repeat if fewer than ``k`` are before it: the ``i``-th taken number ``t`` has ``t - i``
    free ones before it, and moves all repeats beyond those up by one. Rows are carried
    along, not joined back, so a path that occurs again is one more file.
    """
    held = files.select(F.col("stem").alias("_s"), F.col("ext").alias("_e"), F.col("path").alias("_p"), F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("_row"))
    names = files.select("stem", "ext")
    if existing is None:
        held = held.withColumn("_there", F.lit(0))
    else:
        there = existing.select(F.col("stem").alias("_s"), F.col("ext").alias("_e")).distinct()
        names = names.unionByName(existing.select("stem", "ext"))
        held = held.join(there.withColumn("_there", F.lit(1)), ["_s", "_e"], "left").withColumn("_there", F.coalesce("_there", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_s", "_e").orderBy("_p")) - 1 + F.col("_there")
    rows = held.select("_s", "_e", nth.cast("long").alias("_v"), F.lit(0).alias("_taken"), "_row")
    numbered_stem = F.regexp_extract("stem", r"^(.*)_([1-9][0-9]{0,17})$", 1)
    number = F.expr(r"try_cast(nullif(regexp_extract(stem, '^(.*)_([1-9][0-9]{0,17})$', 2), '') AS bigint)")
    taken = names.select(numbered_stem.alias("_s"), F.col("ext").alias("_e"), number.alias("_t")).filter("_t is not null").distinct()
    before = F.col("_t") - F.row_number().over(Window.partitionBy("_s", "_e").orderBy("_t"))
    marks = taken.select("_s", "_e", before.alias("_v"), F.lit(1).alias("_taken"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    upto = Window.partitionBy("_s", "_e").orderBy("_v", "_taken").rowsBetween(Window.unboundedPreceding, 0)
    moved = rows.unionByName(marks).withColumn("_n", F.col("_v") + F.sum("_taken").over(upto)).filter("_taken = 0")
    target = F.when(F.col("_v") == 0, F.concat("_s", "_e")).otherwise(F.concat("_s", F.lit("_"), F.col("_n").cast("string"), "_e"))
    return moved.withColumn("_target", target).select(*[F.col("_row").getField(c).alias(c) for c in files.columns if c != "target"], F.col("_target").alias("target"))


def species_rollup(df: DataFrame) -> DataFrame:
    """AGG16: counts for each prefix of the four ranks."""
    return df.rollup("order_cn", "family_cn", "genus_cn", "species_cn").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def screened_paths(kept: DataFrame, folder: str, target: str, raw_suffixes: list[str]) -> DataFrame:
    """PRJ7: where each kept path was copied to; raw files have become JPEG."""
    rel = F.replace(F.expr("path"), F.lit("\\"), F.lit("/"))
    rel = F.regexp_replace(rel, "^" + folder.rstrip("/") + "/", "")
    ext = F.lower(F.regexp_extract(rel, r"(\.[^./]+)$", 1))
    jpeg = F.regexp_replace(rel, r"\.[^./]+$", ".jpg")
    return kept.withColumn("screened", F.concat(F.lit(target.rstrip("/") + "/"), F.when(ext.isin(raw_suffixes), jpeg).otherwise(rel)))


def existing(plan: DataFrame, listing: DataFrame, column: str = "screened") -> DataFrame:
    """JN10: rows whose file is in the listing."""
    return plan.join(listing.select(F.col("path").alias(column)).distinct(), column, "left_semi")
