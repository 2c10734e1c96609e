"""The largest JPEG that a raw file carries, found through its own tables.

Three kinds of container are walked: TIFF (most raw formats) with its directories,
sub-directories and strips; box files (CR3) with preview boxes and sample tables;
and the fixed header of RAF. Offsets that leave the file, directories met before and
more than a bounded number of them end a walk. Nothing is demosaiced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directories or boxes of a file that are looked at.
MOST = 4_096
#: TIFF tags of compression, strips, sub-directories, a JPEG and its length, an embedded JPEG; JPEG compressions.
COMPRESSION, STRIPS, STRIP_BYTES, SUB, JPEG_AT, JPEG_BYTES, WHOLE_JPEG, EXIF = 0x103, 0x111, 0x117, 0x14A, 0x201, 0x202, 0x2E, 0x8769
JPEG_KINDS = (6, 7, 99, 34892)
#: Headers of TIFF variants, boxes that hold boxes, and what comes before the boxes inside others.
TIFF_HEADS = (b"II*\0", b"MM\0*", b"IIU\0", b"IIRO", b"IIRS", b"MMOR")
HOLDERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"uuid": 16}
RAF_HEAD = b"FUJIFILMCCD-RAW "
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 13: 4}


def _directories(data: bytes, base: int = 0) -> Iterator[dict[int, tuple]]:
    """Every directory of a TIFF block as tag to (kind, count, place of the value)."""
    order = "<" if data[base : base + 2] == b"II" else ">"
    if len(data) < base + 8:
        return
    (first,) = struct.unpack_from(order + "I", data, base + 4)
    waiting, seen = [first], set()
    while waiting and len(seen) < MOST:
        at = waiting.pop()
        if at in seen or not 8 <= at <= len(data) - base - 2:
            continue
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, base + at)
        tags = {}
        for i in range(min(n, (len(data) - base - at - 2) // 12)):
            place = base + at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", data, place)
            size = _SIZES.get(kind, 0) * count
            value = place + 8
            if size > 4:
                value = base + struct.unpack_from(order + "I", data, value)[0]
            if size and value + size <= len(data):
                tags[tag] = (kind, count, value)
        yield tags
        for tag in (SUB, EXIF):
            waiting += _numbers(data, order, tags.get(tag))[:MOST]
        end = base + at + 2 + 12 * n
        if end + 4 <= len(data):
            waiting.append(struct.unpack_from(order + "I", data, end)[0])


def _numbers(data: bytes, order: str, entry: tuple | None) -> list[int]:
    if entry is None or entry[0] not in (3, 4, 13):
        return []
    kind, count, value = entry
    return list(struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", data, value))


def _of_tiff(data: bytes) -> Iterator[tuple[int, int]]:
    order = "<" if data[:2] == b"II" else ">"
    for tags in _directories(data):
        yield from zip(_numbers(data, order, tags.get(JPEG_AT)), _numbers(data, order, tags.get(JPEG_BYTES)))
        if (_numbers(data, order, tags.get(COMPRESSION)) or [0])[0] in JPEG_KINDS:
            places, sizes = _numbers(data, order, tags.get(STRIPS)), _numbers(data, order, tags.get(STRIP_BYTES))
            if len(places) == len(sizes) == 1:  # a JPEG in several strips is not one stream
                yield places[0], sizes[0]
        if WHOLE_JPEG in tags:
            _, count, value = tags[WHOLE_JPEG]
            yield value, count


def _of_boxes(data: bytes) -> Iterator[tuple[int, int]]:
    waiting, looked = [(0, len(data))], 0
    while waiting:
        at, end = waiting.pop()
        places: list[int] = []
        sizes: list[int] = []
        while at + 8 <= end and looked < MOST:
            looked += 1
            size, kind = struct.unpack_from(">I4s", data, at)
            body = at + 8
            if size == 1 and at + 16 <= end:
                (size,) = struct.unpack_from(">Q", data, body)
                body += 8
            size = size or end - at
            if size < body - at or at + size > end:
                break
            close = at + size
            if kind in HOLDERS:
                inner = body + HOLDERS[kind]
                if kind == b"uuid" and data[inner + 4 : inner + 8] not in (b"CNCV", b"CMT1", b"THMB", b"PRVW") and data[inner + 12 : inner + 16] == b"PRVW":
                    inner += 8  # a count stands before the boxes
                waiting.append((min(inner, close), close))
            elif kind in (b"PRVW", b"THMB"):
                start = data.find(b"\xff\xd8\xff", body, min(body + 64, close))
                if start >= 0:
                    yield start, close - start
            elif kind == b"stsz" and body + 12 <= close:
                fixed, n = struct.unpack_from(">II", data, body + 4)
                n = min(n, MOST)
                sizes = [fixed] * n if fixed else list(struct.unpack_from(f">{min(n, (close - body - 12) // 4)}I", data, body + 12))
            elif kind in (b"stco", b"co64") and body + 8 <= close:
                (n,) = struct.unpack_from(">I", data, body + 4)
                wide = 8 if kind == b"co64" else 4
                places = list(struct.unpack_from(f">{min(n, MOST, (close - body - 8) // wide)}{'Q' if wide == 8 else 'I'}", data, body + 8))
            at = close
        yield from zip(places, sizes)


def _of_raf(data: bytes) -> Iterator[tuple[int, int]]:
    if len(data) >= 92:
        yield struct.unpack_from(">II", data, 84)


def preview(data: bytes | None) -> bytes | None:
    """SRC9: the longest embedded JPEG of a raw file, or the file if it is one; None if there is none."""
    if not data:
        return None
    if data[:3] == b"\xff\xd8\xff":
        return data
    if data[:4] in TIFF_HEADS:
        found = _of_tiff(data)
    elif data[:16] == RAF_HEAD:
        found = _of_raf(data)
    elif data[4:8] == b"ftyp":
        found = _of_boxes(data)
    else:
        return None
    whole = [(size, at) for at, size in found if size > 3 and at + size <= len(data) and data[at : at + 3] == b"\xff\xd8\xff"]
    if not whole:
        return None
    size, at = max(whole, key=lambda x: (x[0], -x[1]))
    return data[at : at + size]


def previews(files: DataFrame) -> DataFrame:
    """SRC9: ``(path, content, error)`` of ``files(path, content)``: JPEGs to decode, or ``decode_error``.

    A task holds one Arrow batch of files. Null and empty files are errors too.
    """

    def batches(source):
        import pyarrow as pa

        for batch in source:
            for i in range(batch.num_rows):
                value = batch.column(1)[i].as_py()
                try:
                    found = preview(value)
                except (struct.error, ValueError, MemoryError):
                    found = None
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([found], pa.binary()), pa.array([None if found else "decode_error"], pa.string())], ["path", "content", "error"])

    return files.select(F.col("path").cast("string"), F.col("content")).mapInArrow(batches, "path string, content binary, error string")
