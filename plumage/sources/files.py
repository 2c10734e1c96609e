"""Files as a sink: a Python data source that stages what tasks write, and a second job that puts it in place.

Each attempt of a task writes below a folder of its own, with a manifest. Spark tells
the driver which attempts count; only their manifests are listed as committed. The
files are then renamed into place by tasks, each rename being safe to repeat. So a
task that fails half-way or runs twice leaves no file twice, in part, or under a
name that nobody committed. Only one manifest's path an attempt passes the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "plumage_files"
STAGING = ".plumage-staging"
MANIFEST = "dest string, staged string, bytes long, error string"


@dataclass
class Staged(WriterCommitMessage):
    """What the driver hears of one attempt."""

    manifest: str


class FilesWriter(DataSourceWriter):
    """Stages rows ``(dest, src, content)``; see :func:`write_files`."""

    def __init__(self, root: str, job: str):
        self.folder = os.path.join(root, STAGING, job)

    def write(self, iterator: Iterator) -> Staged:
        import json
        import shutil

        own = os.path.join(self.folder, uuid.uuid4().hex)
        os.makedirs(own)
        with open(os.path.join(own, "manifest.json"), "w", encoding="utf-8") as manifest:
            for i, row in enumerate(iterator):
                staged, error = os.path.join(own, f"{i}.part"), None
                try:
                    if not row.dest or row.dest.startswith("/") or ".." in row.dest.split("/"):
                        error = "outside"
                    elif row.content is not None:
                        with open(staged, "wb") as file:
                            file.write(row.content)
                    elif row.src is not None:
                        shutil.copy2(row.src, staged)
                    else:
                        error = "nothing to write"
                except (FileNotFoundError, PermissionError, IsADirectoryError) as e:  # a source's fault; faults of the target end the task
                    if e.filename != row.src:
                        raise
                    error = type(e).__name__
                size = None if error else os.path.getsize(staged)
                manifest.write(json.dumps({"dest": row.dest, "staged": staged, "bytes": size, "error": error}) + "\n")
        return Staged(os.path.join(own, "manifest.json"))

    def commit(self, messages: list) -> None:
        """A link to each manifest that counts, in one folder; attempts that failed have none."""
        counted = os.path.join(self.folder, "committed")
        os.makedirs(counted)
        for i, m in enumerate(messages):
            if m is not None:
                os.replace(m.manifest, os.path.join(counted, f"{i}.json"))

    def abort(self, messages: list) -> None:
        import shutil

        shutil.rmtree(self.folder, ignore_errors=True)


class FilesSource(DataSource):
    """Registered as ``plumage_files``; options ``root`` and ``job``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["root"], self.options["job"])


def _placed(manifests: DataFrame, root: str) -> DataFrame:
    """Committed files renamed into place; repeating it changes nothing."""

    def batches(source):
        import pandas as pd

        for pdf in source:
            errors = []
            for dest, staged, error in zip(pdf["dest"], pdf["staged"], pdf["error"], strict=True):
                if error is None:
                    target = os.path.join(root, dest)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    try:
                        os.replace(staged, target)
                    except FileNotFoundError:  # an attempt before this one has moved it
                        if not os.path.exists(target):
                            error = "lost"
                errors.append(error)
            yield pd.DataFrame({"dest": pdf["dest"], "ok": [e is None for e in errors], "bytes": pdf["bytes"].astype("Int64"), "error": errors})

    return manifests.mapInPandas(batches, "dest string, ok boolean, bytes long, error string")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """SNK2, SNK4-SNK6: write ``files(dest, content)`` or ``(dest, src)`` below ``root``; ``(dest, ok, bytes, error)`` of each.

    ``root`` is a folder that all executors mount; ``dest`` is relative to it, and what
    would leave it is refused. A row has its bytes in ``content`` or a file to copy,
    with its times, in ``src``. A source that can't be read costs its own row; of rows
    with one ``dest`` one is written and the others are told as ``repeated``. Files that
    were there are replaced as wholes. The result is a written table.
    """
    from .tables import materialised

    spark = files.sparkSession
    spark.dataSource.register(FilesSource)
    job = uuid.uuid4().hex
    rows = files.select("dest", *[F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("src", "string"), ("content", "binary"))])
    rows.write.format(NAME).option("root", root).option("job", job).mode("append").save()
    folder = os.path.join(root, STAGING, job)
    manifests = spark.read.schema(MANIFEST).json(f"file://{os.path.abspath(folder)}/committed")
    first = manifests.filter("error is null").groupBy("dest").agg(F.min("staged").alias("_first"))
    told = manifests.join(first, "dest", "left").withColumn("error", F.when(F.col("error").isNull() & (F.col("staged") != F.col("_first")), "repeated").otherwise(F.col("error")))
    told = materialised(told.select("dest", "staged", "bytes", "error"))
    done = materialised(_placed(told, root))
    _dropped(folder)
    return done


def _dropped(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)
    try:
        os.rmdir(os.path.dirname(folder))
    except OSError:
        pass  # another job stages there


def cropped(files: DataFrame, crops: DataFrame, decoder: Callable[[], Callable], encoder: Callable[[], Callable], make: bytes | None = None) -> DataFrame:
    """SNK5: ``(dest, content, error)`` of ``crops(path, dest, x1, y1, x2, y2)`` cut from ``files(path, content)``.

    Each file is decoded once for all its crops. ``decoder()`` makes ``decode(bytes)`` to
    pixels or None, ``encoder()`` makes ``encode(pixels)`` to a JPEG. A JPEG's EXIF block is
    carried over; its maker becomes ``make`` if it has one. Crops are cut at the frame;
    empty ones and undecodable files give an error and no content.
    """
    from ..operators.evaluation import only

    by_file = crops.groupBy("path").agg(F.collect_list(F.struct("dest", "x1", "y1", "x2", "y2")).alias("crops"))  # as many as one image has species
    wanted = only(files.select("path", "content"), by_file.select("path")).join(by_file, "path")

    def batches(source):
        import pandas as pd

        from .images import exif_block
        from .sinks import with_exif

        decode, encode = decoder(), encoder()
        for pdf in source:
            out = []
            for content, boxes in zip(pdf["content"], pdf["crops"], strict=True):
                try:
                    pixels, fault = decode(bytes(content)), "not decoded"
                except Exception as e:  # noqa: BLE001  told for each crop of the file
                    pixels, fault = None, f"{type(e).__name__}: {e}"
                block = exif_block(bytes(content))
                for b in boxes:
                    if pixels is None:
                        out.append((b["dest"], None, fault))
                        continue
                    h, w = pixels.shape[:2]
                    cut = pixels[max(0, b["y1"]) : min(h, b["y2"]), max(0, b["x1"]) : min(w, b["x2"])]
                    if not cut.size:
                        out.append((b["dest"], None, "empty"))
                        continue
                    jpeg = encode(cut)
                    try:
                        jpeg = with_exif(jpeg, block, make) if block else jpeg
                    except ValueError:
                        pass  # the block doesn't fit: the crop stands without it
                    out.append((b["dest"], jpeg, None))
            yield pd.DataFrame(out, columns=["dest", "content", "error"])

    return wanted.select("content", "crops").mapInPandas(batches, "dest string, content binary, error string")


def relative(path: Column, folder: str) -> Column:
    """A path below ``folder`` without it; others keep their last name (SNK2)."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^file:/+", "/")
    head = folder.rstrip("/") + "/"
    return F.when(plain.startswith(head), F.substr(plain, F.lit(len(head) + 1))).otherwise(F.regexp_extract(plain, r"([^/]*)$", 1))
