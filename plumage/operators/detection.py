"""Injected detectors: birds and their eyes in every image, and what is kept of them.

A detector is ``detector(pixels, conf) -> [(x1, y1, x2, y2, conf, cls), ...]`` with
``pixels`` as an array of height, width and channels; a seventh element may be the
outline of the subject, as points of the frame. A factory makes it once in each
task, so models are loaded where they run and never travel. Only boxes and outlines
leave the task; all rules on them are column functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import boxes as B

Detector = Callable[[object, float], list[tuple]]

#: The class of birds, thresholds, the share an eye's search area is widened by, eyes kept of a bird, pixels around a crop.
BIRD_CLASS = 14
BIRD_CONFIDENCE = 0.3
EYE_CONFIDENCE = 0.25
EYE_MARGIN = 0.12
EYE_TOLERANCE = 0.06
EYES_PER_BIRD = 2
CROP_PIXELS = 10

EYE = "struct<ord:int,x1:double,y1:double,x2:double,y2:double,conf:double,cls:int>"
BIRDS = f"array<struct<ord:int,x1:int,y1:int,x2:int,y2:int,conf:double,cls:int,eyes:array<{EYE}>,mask:array<struct<x:double,y:double>>>>"
DETECTED = f"path string, width int, height int, birds {BIRDS}, error string"


def grown_box(box: tuple, width: int, height: int, margin: float) -> tuple[int, int, int, int]:
    """:func:`boxes.expanded` for one box, beside the pixels; an int is a margin in pixels (PRJ4)."""
    x1, y1, x2, y2 = box
    m = margin if isinstance(margin, int) else int(max(x2 - x1, y2 - y1, 1) * margin)
    grown = max(0, x1 - m), max(0, y1 - m), min(width, x2 + m), min(height, y2 + m)
    if isinstance(margin, int) or (grown[2] > grown[0] and grown[3] > grown[1]):
        return grown
    return max(0, x1), max(0, y1), min(width, x2), min(height, y2)


def frames_of(batch):
    """``(path, width, height, pixels)`` of a batch of ``origin, height, width, nChannels, data``.

    Pixels are views of the batch's own buffer, or None where they can't be decoded.
    """
    import numpy as np

    columns = [batch.column(i) for i in range(5)]
    for origin, h, w, c, data in zip(*columns, strict=True):
        path, h, w, c = origin.as_py(), h.as_py(), w.as_py(), c.as_py()
        raw = data.as_buffer() if data.is_valid else None
        fits = raw is not None and None not in (h, w, c) and h >= 1 and w >= 1 and raw.size == h * w * c
        yield path, w, h, np.frombuffer(raw, np.uint8).reshape(h, w, c) if fits else None


def pixel_columns(images: DataFrame) -> DataFrame:
    """The columns of Spark's ``image`` source that :func:`frames_of` reads."""
    i = F.col("image")
    return images.select(*[i[c].alias(c) for c in ("origin", "height", "width", "nChannels", "data")])


def wanted(bird: dict, classes: tuple[int, ...] | None, conf: float) -> bool:
    """FLT2, FLT3 beside the pixels."""
    return bird["conf"] >= conf and (classes is None or bird["cls"] in classes)


def found_in(pixels, bird_model: Detector, eye_model: Detector | None, conf: float, eye_conf: float, classes: tuple[int, ...] | None, margin: float) -> tuple[list[dict], str | None]:
    """Boxes of one image, and the fault of a detector if one was raised."""
    birds: list[dict] = []
    if pixels is None:
        return birds, None
    h, w = pixels.shape[:2]
    try:
        for i, (x1, y1, x2, y2, p, cls, *rest) in enumerate(bird_model(pixels, conf)):
            mask = [{"x": float(x), "y": float(y)} for x, y in rest[0]] if rest and rest[0] is not None else None
            birds.append({"ord": i, "x1": int(x1), "y1": int(y1), "x2": int(x2), "y2": int(y2), "conf": float(p), "cls": int(cls), "eyes": [], "mask": mask})
        for bird in birds if eye_model else []:
            ax, ay, bx, by = grown_box((bird["x1"], bird["y1"], bird["x2"], bird["y2"]), w, h, margin)
            if not wanted(bird, classes, conf) or bx <= ax or by <= ay:
                continue
            for i, (x1, y1, x2, y2, p, cls, *_) in enumerate(eye_model(pixels[ay:by, ax:bx], eye_conf)):
                bird["eyes"].append({"ord": i, "x1": float(x1) + ax, "y1": float(y1) + ay, "x2": float(x2) + ax, "y2": float(y2) + ay, "conf": float(p), "cls": int(cls)})
    except Exception as e:  # noqa: BLE001  a detector's fault costs its image, and is told
        return birds, f"{type(e).__name__}: {e}"
    return birds, None


def detected(
    images: DataFrame, birds: Callable[[], Detector], eyes: Callable[[], Detector] | None = None, conf: float = BIRD_CONFIDENCE, eye_conf: float = EYE_CONFIDENCE,
    classes: tuple[int, ...] | None = (BIRD_CLASS,), margin: float = EYE_MARGIN,
) -> DataFrame:
    """IMG8, IMG9, IMG10, UDF2: one row for each row of Spark's ``image`` source, with all boxes found.

    ``birds`` keeps the detector's order in ``ord``, coordinates truncated. Eyes are
    sought around boxes of ``classes`` (None: all) from ``conf`` on, and are given in the
    frame's coordinates; ``margin`` is a share of the box, or pixels if an int. An image
    that can't be decoded has no boxes and a null error; where a detector raises,
    ``error`` has its text and the boxes found before stay.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(DETECTED))

    def batches(source):
        import pyarrow as pa

        bird_model, eye_model = birds(), eyes() if eyes else None
        for batch in source:
            out = []
            for path, w, h, pixels in frames_of(batch):
                found, error = found_in(pixels, bird_model, eye_model, conf, eye_conf, classes, margin)
                out.append({"path": path, "width": w, "height": h, "birds": found, "error": error})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return pixel_columns(images).mapInArrow(batches, DETECTED)


def of_class(birds: Column, classes: tuple[int, ...] | None = (BIRD_CLASS,), conf: float = BIRD_CONFIDENCE) -> Column:
    """FLT2, FLT3: boxes of the classes (None: all) from the threshold on, in their order."""
    known = lambda b: F.lit(True) if classes is None else b["cls"].isin(*classes)
    return F.filter(birds, lambda b: known(b) & (b["conf"] >= F.lit(conf)))


def box_area(box: Column) -> Column:
    """Pixels of a box, as a double."""
    return B.area(box["x1"], box["y1"], box["x2"], box["y2"]).cast("double")


def largest(birds: Column) -> Column:
    """AGG4: the box with the most pixels, the first of equal ones; null without boxes."""
    return F.array_max(F.transform(birds, lambda b: F.struct(box_area(b).alias("area"), (-b["ord"]).alias("turn"), b.alias("box"))))["box"]


def with_own_eyes(birds: Column, tolerance: float = EYE_TOLERANCE, most: int = EYES_PER_BIRD) -> Column:
    """FLT6, WIN6: of each bird the surest eyes whose middle lies in its box; ``most`` at most, one at least.

    Of equally sure eyes the first found stays.
    """

    def inside(b: Column):
        return lambda e: B.holds((e["x1"] + e["x2"]) * 0.5, (e["y1"] + e["y2"]) * 0.5, b["x1"], b["y1"], b["x2"], b["y2"], tolerance)

    def surer(x: Column, y: Column) -> Column:
        return F.when(x["conf"] > y["conf"], -1).when(x["conf"] < y["conf"], 1).otherwise(F.signum(x["ord"] - y["ord"]).cast("int"))

    return F.transform(birds, lambda b: b.withField("eyes", F.slice(F.array_sort(F.filter(b["eyes"], inside(b)), surer), 1, max(1, most))))


def screened(found: DataFrame, classes: tuple[int, ...] | None = (BIRD_CLASS,), conf: float = BIRD_CONFIDENCE, tolerance: float = EYE_TOLERANCE, most: int = EYES_PER_BIRD) -> DataFrame:
    """AGG4, AGG5: rows of :func:`detected` with their kept boxes, and for bursts ``area``, ``n_eyes`` and ``has_eye``.

    Images without a bird have an area of 0 and no eyes. ``best`` is the largest bird.
    """
    df = found.withColumn("birds", with_own_eyes(of_class(F.col("birds"), classes, conf), tolerance, most)).withColumn("best", largest(F.col("birds")))
    eyes = F.aggregate("birds", F.lit(0), lambda n, b: n + F.size(b["eyes"]))
    return df.withColumns({"n_birds": F.size("birds"), "area": F.coalesce(box_area(F.col("best")), F.lit(0.0)), "n_eyes": eyes, "has_eye": eyes > 0})
