"""Writers: nested reports, usage, archive metadata, and file copies by plan."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(nested: DataFrame, path: str) -> None:
    """SNK1: burst reports as JSON lines, one row a burst, in parallel files."""
    nested.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_usage(usage: DataFrame, path: str) -> None:
    """SNK13: daily usage; days that are written again replace their partition."""
    usage.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def write_archive(plan: DataFrame, path: str) -> None:
    """SNK5: the archive's metadata by its first two ranks."""
    plan.write.mode("overwrite").partitionBy("order_cn", "family_cn").parquet(path)


def copied(plan: DataFrame, root: str) -> DataFrame:
    """SNK2, SNK6: copy the files of ``plan(src, dest)`` below ``root``, see :func:`files.write_files`."""
    from .files import write_files

    return write_files(plan.select("src", "dest"), root)


def gps_directory(lat: float, lon: float, alt: float | None, at: int, order: str = ">") -> bytes:
    """SNK3: a GPS directory for place ``at`` of a TIFF block: degrees, minutes and hundredths of seconds, truncated."""

    def dms(v: float) -> bytes:
        v = abs(v)
        d = int(v)
        m = int((v - d) * 60)
        return struct.pack(order + "6I", d, 1, m, 1, int(((v - d) * 60 - m) * 60 * 100), 100)

    entries = [(0, 1, 4, bytes((2, 0, 0, 0))), (1, 2, 2, (b"S" if lat < 0 else b"N") + b"\0\0\0"), (2, 5, 3, dms(lat)), (3, 2, 2, (b"W" if lon < 0 else b"E") + b"\0\0\0"), (4, 5, 3, dms(lon))]
    if alt is not None:
        entries += [(5, 1, 1, bytes((alt < 0, 0, 0, 0))), (6, 5, 1, struct.pack(order + "2I", int(abs(alt)), 1))]
    data_at, data, body = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, n, value in entries:
        if len(value) > 4:
            body += struct.pack(order + "HHII", tag, kind, n, data_at + len(data))
            data += value
        else:
            body += struct.pack(order + "HHI", tag, kind, n) + value
    return struct.pack(order + "H", len(entries)) + body + b"\0\0\0\0" + data


def tiff_with_gps(tiff: bytes, lat: float, lon: float, alt: float | None = None) -> bytes:
    """A TIFF block with a new GPS directory; all other tags stay where they are.

    The first directory is copied to the end with a pointer to the new one, as there
    may be no room for it in its place. ValueError for other data.
    """
    order = {b"MM\0*": ">", b"II*\0": "<"}.get(tiff[:4])
    if order is None or len(tiff) < 8:
        raise ValueError("no TIFF block")
    (first,) = struct.unpack_from(order + "I", tiff, 4)
    entries, follow = [], b"\0\0\0\0"
    if first:
        (n,) = struct.unpack_from(order + "H", tiff, first)
        end = first + 2 + 12 * n
        if end > len(tiff):
            raise ValueError("the first directory is cut short")
        entries = [tiff[first + 2 + 12 * i : first + 14 + 12 * i] for i in range(n)]
        follow = (tiff[end : end + 4] + follow)[:4]
    out = tiff + b"\0" * (len(tiff) % 2)
    at = len(out)
    entries = [e for e in entries if struct.unpack_from(order + "H", e)[0] != 0x8825]
    gps_at = at + 2 + 12 * (len(entries) + 1) + 4
    entries = sorted([*entries, struct.pack(order + "HHII", 0x8825, 4, 1, gps_at)], key=lambda e: struct.unpack_from(order + "H", e)[0])
    directory = struct.pack(order + "H", len(entries)) + b"".join(entries) + follow
    return out[:4] + struct.pack(order + "I", at) + out[8:] + directory + gps_directory(lat, lon, alt, gps_at, order)


def tiff_with_maker(tiff: bytes, make: bytes) -> bytes:
    """A TIFF block whose maker (tag 271) is ``make``, if it has one; all else stays where it is."""
    order = {b"MM\0*": ">", b"II*\0": "<"}.get(tiff[:4])
    if order is None or len(tiff) < 8:
        raise ValueError("no TIFF block")
    (first,) = struct.unpack_from(order + "I", tiff, 4)
    if not 8 <= first <= len(tiff) - 2:
        return tiff
    (n,) = struct.unpack_from(order + "H", tiff, first)
    for at in range(first + 2, min(first + 2 + 12 * n, len(tiff) - 11), 12):
        if struct.unpack_from(order + "H", tiff, at)[0] == 271:
            end = len(tiff) + len(tiff) % 2
            text = make + b"\0"
            value = text.ljust(4, b"\0") if len(text) <= 4 else struct.pack(order + "I", end)
            return tiff[:at] + struct.pack(order + "HHI", 271, 2, len(text)) + value + tiff[at + 12 :] + (b"" if len(text) <= 4 else b"\0" * (len(tiff) % 2) + text)
    return tiff


def _segments(jpeg: bytes) -> tuple[bytes | None, bytes]:
    """The EXIF block of a JPEG, and all that follows its first marker without it."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    tiff, rest, at = None, [], 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF and jpeg[at + 1] != 0xDA:
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if jpeg[at + 1] == 0xE1 and jpeg[at + 4 : at + 10] == b"Exif\0\0":
            tiff = jpeg[at + 10 : at + 2 + size]
        else:
            rest.append(jpeg[at : at + 2 + size])
        at += 2 + size
    return tiff, b"".join(rest) + jpeg[at:]


def with_exif(jpeg: bytes, tiff: bytes, make: bytes | None = None) -> bytes:
    """A JPEG with the EXIF block ``tiff`` in place of its own. ValueError for other data or if there is no room."""
    payload = b"Exif\0\0" + (tiff if make is None else tiff_with_maker(tiff, make))
    if len(payload) > 65_533:
        raise ValueError("no room in the EXIF segment")
    return b"".join([b"\xff\xd8\xff\xe1", struct.pack(">H", len(payload) + 2), payload, _segments(jpeg)[1]])


def with_gps(jpeg: bytes, lat: float, lon: float, alt: float | None = None) -> bytes:
    """A JPEG with its position set; all other EXIF tags stay. ValueError for other data or if EXIF has no room."""
    return with_exif(jpeg, tiff_with_gps(_segments(jpeg)[0] or b"MM\0*\0\0\0\0", lat, lon, alt))


def gps_written(files: DataFrame) -> DataFrame:
    """SNK3, SNK4: ``(path, content, ok)`` of ``files(path, content, lat, lon)`` with positions set, and altitudes if there is ``alt``."""

    def batches(source):
        import pandas as pd

        for pdf in source:
            rows = []
            for path, content, lat, lon, alt in pdf.itertuples(index=False):
                try:
                    rows.append((path, with_gps(bytes(content), lat, lon, None if pd.isna(alt) else alt), True))
                except (ValueError, TypeError, struct.error):
                    rows.append((path, content, False))
            yield pd.DataFrame(rows, columns=["path", "content", "ok"])

    alt = F.col("alt") if "alt" in files.columns else F.lit(None)
    return files.select("path", "content", "lat", "lon", alt.cast("double").alias("alt")).mapInPandas(batches, "path string, content binary, ok boolean")


def written_count(results: DataFrame) -> DataFrame:
    """AGG12: how many succeeded."""
    return results.agg(F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("total"))
