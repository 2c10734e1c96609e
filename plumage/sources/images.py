"""Photo listings, capture times and positions from file bytes."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import from_dms, valid
from ..functions.text import suffix

#: Suffixes of photos that can be decoded everywhere, and of raw formats.
STANDARD = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp", ".gif")
RAW = (
    ".3fr", ".ari", ".arw", ".bay", ".cr2", ".cr3", ".crw", ".cs1", ".dcr", ".dcs", ".dng", ".drf", ".eip", ".erf", ".fff", ".iiq", ".k25", ".kdc", ".mdc",
    ".mef", ".mos", ".mrw", ".nef", ".nrw", ".orf", ".pef", ".ptx", ".pxn", ".r3d", ".raf", ".raw", ".rw2", ".rwl", ".sr2", ".srf", ".srw", ".x3f",
)
XMP_FILE_LIMIT = 60 * 1024 * 1024
XMP_HEAD = 8_000_000

EXIF_SCHEMA = "exif_original string, exif_digitized string, exif_datetime string, model string, f_number struct<num:int,den:int>, exposure struct<num:int,den:int>, focal struct<num:int,den:int>, iso int, lat_ref string, lat array<struct<num:int,den:int>>, lon_ref string, lon array<struct<num:int,den:int>>, alt struct<num:int,den:int>"


def listing(spark: SparkSession, folder: str, recursive: bool = False, suffixes: tuple[str, ...] = STANDARD + RAW) -> DataFrame:
    """SRC1-SRC6: photos of a folder, without contents: ``path, modificationTime, length``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).filter(suffix(F.col("path")).isin(*suffixes)).dropDuplicates(["path"]).select("path", "modificationTime", "length")


def contents(spark: SparkSession, folder: str, recursive: bool = False, suffixes: tuple[str, ...] = STANDARD) -> DataFrame:
    """The same with ``content``; keep it out of shuffles."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).filter(suffix(F.col("path")).isin(*suffixes))


def decoded(spark: SparkSession, folder: str, drop_invalid: bool = True) -> DataFrame:
    """SRC8-SRC11: decoded images (BGR bytes); with ``drop_invalid`` false, bad files stay as empty rows."""
    return spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).option("recursiveFileLookup", "true").load(folder)


def whole(images: DataFrame) -> DataFrame:
    """SRC11: decoded images, or an error that names the first one that can't be."""
    i = F.col("image")
    broken = (i["data"].isNull()) | (F.octet_length(i["data"]) < 1) | (i["height"] < 1)
    return images.withColumn("image", F.when(broken, F.raise_error(F.concat(F.lit("not decoded: "), F.coalesce(i["origin"], F.lit("?"))))).otherwise(i))


def as_rgb(images: DataFrame) -> DataFrame:
    """SRC10: ``(path, height, width, rgb)`` of decoded images; gray ones get three equal channels, undecodable ones null."""

    def batches(source):
        import numpy as np
        import pyarrow as pa

        from ..operators.detection import frames_of

        for batch in source:
            rows = []
            for path, w, h, pixels in frames_of(batch):
                rgb = None if pixels is None else np.ascontiguousarray(np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] < 3 else pixels[:, :, 2::-1]).tobytes()
                rows.append((path, h, w, rgb))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["path", "height", "width", "rgb"])

    from ..operators.detection import pixel_columns

    return pixel_columns(images).mapInArrow(batches, "path string, height int, width int, rgb binary")


def in_order(files: DataFrame) -> DataFrame:
    """SRT1: a listing by path, sorted over its tasks."""
    return files.orderBy("path")


def raw_supported() -> bool:
    """Whether the optional raw decoder is installed."""
    import importlib.util

    return importlib.util.find_spec("rawpy") is not None


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif_tags(data: bytes | None) -> dict[int | tuple[str, int], object]:
    """Tags of a JPEG's or TIFF's directories, (directory, tag) to value; {} if there are none.

    Offsets that leave the data, and directories that refer back, end the walk.
    """
    if not data:
        return {}
    tiff = data if data[:4] in (b"II*\0", b"MM\0*") else _app1(data)
    if tiff is None or len(tiff) < 8 or tiff[:4] not in (b"II*\0", b"MM\0*"):
        return {}
    order = "<" if tiff[:2] == b"II" else ">"
    out: dict = {}

    def walk(at: int, name: str) -> None:
        if not 8 <= at <= len(tiff) - 2:
            return
        (count,) = struct.unpack_from(order + "H", tiff, at)
        for i in range(min(count, (len(tiff) - at - 2) // 12)):
            tag, kind, n = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * i)
            size = _SIZES.get(kind, 0) * n
            place = at + 10 + 12 * i
            if size > 4:
                (place,) = struct.unpack_from(order + "I", tiff, place)
            if not size or place + size > len(tiff):
                continue
            if kind in (1, 7):
                value: object = tiff[place : place + size]
            elif kind == 2:
                value = tiff[place : place + size].split(b"\0")[0].decode("utf-8", "replace")
            elif kind in (3, 4, 9):
                value = struct.unpack_from(f"{order}{n}{ {3: 'H', 4: 'I', 9: 'i'}[kind]}", tiff, place)
            else:
                flat = struct.unpack_from(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", tiff, place)
                value = tuple(zip(flat[::2], flat[1::2], strict=True))
            out[name, tag] = value
            if name == "0th" and tag in (0x8769, 0x8825) and kind == 4:
                walk(value[0], "exif" if tag == 0x8769 else "gps")

    walk(struct.unpack_from(order + "I", tiff, 4)[0], "0th")
    return out


def _app1(data: bytes) -> bytes | None:
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if marker == 0xDA or size < 2:
            return None
        at += 2 + size
    return None


def exif_block(data: bytes | None) -> bytes | None:
    """The TIFF block with a JPEG's EXIF tags; None for other data."""
    return _app1(data) if data else None


def exif_row(data: bytes | None) -> tuple:
    """The columns of EXIF_SCHEMA; absent and malformed tags are null."""
    tags = exif_tags(data)

    def text(*key):
        value = tags.get(key)
        return value.strip() if isinstance(value, str) and value.strip() else None

    def ratios(*key):
        value = tags.get(key)
        return [{"num": a, "den": b} for a, b in value if max(abs(a), abs(b)) < 1 << 31] if isinstance(value, tuple) and value and isinstance(value[0], tuple) else None

    one = lambda *key: (ratios(*key) or [None])[0]
    iso = tags.get(("exif", 0x8827))
    return (text("exif", 0x9003), text("exif", 0x9004), text("0th", 0x0132), text("0th", 0x0110), one("exif", 0x829D), one("exif", 0x829A), one("exif", 0x920A), int(iso[0]) if isinstance(iso, tuple) else None, text("gps", 1), ratios("gps", 2), text("gps", 3), ratios("gps", 4), one("gps", 6))


def with_exif(files: DataFrame, keep: tuple[str, ...] = ("path", "modificationTime", "length")) -> DataFrame:
    """SRC12, SRC14, SRC15: EXIF columns of files with ``content`` beside those to keep; the content goes."""
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(EXIF_SCHEMA)]
    rows = files.select(*keep, "content")
    kept = StructType(rows.schema.fields[:-1] + StructType.fromDDL(EXIF_SCHEMA).fields)

    def batches(source):
        import pandas as pd

        for pdf in source:
            tags = pd.DataFrame([exif_row(c) for c in pdf["content"]], columns=names, index=pdf.index, dtype=object)
            yield pd.concat([pdf[list(keep)], tags], axis=1)

    return rows.mapInPandas(batches, kept)


def positioned(files: DataFrame) -> DataFrame:
    """SRC15 as one call: ``(path, lat, lon, altitude, origin)`` of ``files(path, length, content)``.

    The position in EXIF counts, else the one in XMP; ``origin`` is ``exif``, ``xmp`` or
    null. Files are read once, and contents don't leave their task.
    """
    xmp = files.select("path", "content", xmp_position(xmp_text(F.col("content"), F.col("length"))).alias("_xmp"))
    df = with_exif(xmp.select("path", "content", F.col("_xmp.lat").alias("_xlat"), F.col("_xmp.lon").alias("_xlon")), ("path", "_xlat", "_xlon"))
    own = position(F.col("lat"), F.col("lat_ref"), F.col("lon"), F.col("lon_ref"))
    df = df.select("path", own.alias("_own"), altitude(F.col("alt")).alias("altitude"), "_xlat", "_xlon")
    exif = F.col("_own.lat").isNotNull() & F.col("_own.lon").isNotNull()
    origin = F.when(exif, "exif").when(F.col("_xlat").isNotNull(), "xmp")
    return df.select("path", F.when(exif, F.col("_own.lat")).otherwise(F.col("_xlat")).alias("lat"), F.when(exif, F.col("_own.lon")).otherwise(F.col("_xlon")).alias("lon"), F.when(exif, F.col("altitude")).alias("altitude"), origin.alias("origin"))


def capture_time(original: Column, digitized: Column, plain: Column, mtime: Column) -> Column:
    """SRC12, SRC13: the first EXIF time that parses, else the file's."""
    parsed = lambda t: F.when(F.length(t) >= 19, F.try_to_timestamp(F.substring(t, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")))
    return F.coalesce(parsed(original), parsed(digitized), parsed(plain), mtime)


def caption_date(original: Column, plain: Column) -> Column:
    """SRC17."""
    return F.translate(F.substring(F.coalesce(original, plain, F.lit("")), 1, 10), ":", "-")


def position(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column) -> Column:
    """SRC14: a struct (lat, lon), null without both axes."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(from_dms(lat, lat_ref).alias("lat"), from_dms(lon, lon_ref).alias("lon")))


def altitude(alt: Column) -> Column:
    return alt["num"] / F.nullif(alt["den"], F.lit(0))


def xmp_text(content: Column, length: Column) -> Column:
    """SRC16: the head of a file as text, null beyond the size limit or without a position."""
    text = F.substring(content, 1, XMP_HEAD).cast("string")  # bytes that are no UTF-8 don't matter
    return F.when((length <= XMP_FILE_LIMIT) & text.contains("GPSLatitude"), text)


def xmp_axis(text: Column, tag: str, letters: tuple[str, str]) -> Column:
    """SRC16: one axis in decimal degrees: a decimal or degrees, minutes, seconds.

    ``letters``: the reference for positive and for negative values; the negative
    one turns positive values around.
    """
    body = F.trim(F.regexp_extract(text, f"(?i){tag}" + r"\s*[^>]*>([^<]+)<", 1))
    parts = F.split(body, r"[,，]\s*")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    dms = number(0) + number(1) / 60.0 + number(2) / 3600.0
    value = F.when(body.rlike(r"^[+-]?\d+(\.\d+)?$"), body.try_cast("double")).when(F.size(parts) >= 3, dms)
    ref = F.upper(F.trim(F.regexp_extract(text, f"(?i){tag}Ref" + r"\s*[^>]*>([^<]+)<", 1)))
    word = {"N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST"}[letters[1]]
    negative = ref.contains(word) | ref.startswith(letters[1])
    return F.when(negative & (value > 0), -value).otherwise(value)


def xmp_position(text: Column) -> Column:
    """SRC16: a struct (lat, lon) of valid coordinates, else null."""
    lat, lon = xmp_axis(text, "GPSLatitude", ("N", "S")), xmp_axis(text, "GPSLongitude", ("E", "W"))
    return F.when(valid(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))
