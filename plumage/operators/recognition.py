"""Injected classifiers: crops of many images in bounded batches, and what becomes of the answers.

A classifier is ``classifier(crops) -> logits``: an array of ``n`` prepared crops
(float32, 3 x 224 x 224) to an array of ``n`` rows of logits. A factory makes it once
in each task. Crops of successive images fill one batch up to a number of bytes,
and each answer goes back to the image and box that it belongs to; pixels are read
once and never leave their task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import detection, refine

Classifier = Callable[[object], object]

#: Shorter side before the cut, side of the cut, channel means and deviations (RGB), candidates of a detection.
SHORT_SIDE, CUT = 256, 224
MEAN = (0.485, 0.456, 0.406)
DEVIATION = (0.229, 0.224, 0.225)
TOP = 10
UNKNOWN_NAME = "未知"

#: Bytes of crops of a model batch: some 100 crops.
BATCH_BYTES = 64_000_000
#: Images that wait for a batch at most.
WAITING = 1_024

CLASSIFIED = detection.DETECTED.replace(",y:double>>>>", ",y:double>>,logits:array<float>>>")


def _weights(size: int, new: int):
    """Rows of the linear filter that takes ``size`` samples to ``new``, widened when shrinking."""
    import numpy as np

    scale = size / new
    reach = max(scale, 1.0)
    middle = (np.arange(new) + 0.5) * scale
    distance = np.abs(np.arange(size)[None, :] + 0.5 - middle[:, None])
    weight = np.maximum(0.0, 1.0 - distance / reach)
    return weight / weight.sum(axis=1, keepdims=True)


def resized(pixels, height: int, width: int):
    """An image of another size, by an anti-aliased linear filter, as bytes."""
    import numpy as np

    x = np.tensordot(_weights(pixels.shape[0], height), pixels.astype(np.float64), axes=(1, 0))
    x = np.tensordot(_weights(pixels.shape[1], width), x, axes=(1, 1)).transpose(1, 0, 2)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def prepared(crop):
    """IMG11: a BGR (or gray) crop as the classifier takes it: shorter side, middle cut, normalised RGB planes."""
    import numpy as np

    if crop.shape[2] < 3:
        crop = np.repeat(crop[:, :, :1], 3, axis=2)
    h, w = crop.shape[:2]
    size = (SHORT_SIDE, int(SHORT_SIDE * w / h)) if h <= w else (int(SHORT_SIDE * h / w), SHORT_SIDE)
    rgb = resized(crop[:, :, 2::-1], *size)
    top, left = round((size[0] - CUT) / 2), round((size[1] - CUT) / 2)
    x = rgb[top : top + CUT, left : left + CUT].astype(np.float32) / np.float32(255)
    return ((x - np.float32(MEAN)) / np.float32(DEVIATION)).transpose(2, 0, 1)


def classified(
    images: DataFrame, birds: Callable[[], detection.Detector], classifier: Callable[[], Classifier], eyes: Callable[[], detection.Detector] | None = None, conf: float = detection.BIRD_CONFIDENCE,
    eye_conf: float = detection.EYE_CONFIDENCE, classes: tuple[int, ...] | None = None, margin: int = detection.CROP_PIXELS, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """IMG10, IMG11: rows of :func:`detection.detected` whose boxes have ``logits``.

    Boxes of ``classes`` (None: all) from ``conf`` on are cropped with ``margin`` pixels
    around; empty crops and other boxes have null logits. A batch that raises is
    repeated crop by crop, so a fault costs one crop and is told in its image's
    ``error``. Images that can't be decoded have no boxes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(CLASSIFIED))

    def batches(source):
        import numpy as np
        import pyarrow as pa

        bird_model, eye_model, model = birds(), eyes() if eyes else None, classifier()
        waiting: list[dict] = []
        crops: list = []
        owners: list[tuple[dict, dict]] = []

        def answer() -> None:
            try:
                found = np.asarray(model(np.stack(crops)), dtype=np.float32)
                for (_, bird), row in zip(owners, found, strict=True):
                    bird["logits"] = row.tolist()
            except Exception:  # noqa: BLE001  one by one, to find the crop that is at fault
                for (row, bird), crop in zip(owners, crops, strict=True):
                    try:
                        bird["logits"] = np.asarray(model(crop[None]), dtype=np.float32)[0].tolist()
                    except Exception as e:  # noqa: BLE001
                        row["error"] = row["error"] or f"{type(e).__name__}: {e}"
            crops.clear()
            owners.clear()

        def handed_on():
            out = pa.RecordBatch.from_pylist(waiting, schema=schema)
            waiting.clear()
            return out

        for batch in source:
            for path, w, h, pixels in detection.frames_of(batch):
                found, error = detection.found_in(pixels, bird_model, eye_model, conf, eye_conf, classes, margin)
                row = {"path": path, "width": w, "height": h, "birds": found, "error": error}
                waiting.append(row)
                for bird in found:
                    x1, y1, x2, y2 = detection.grown_box((bird["x1"], bird["y1"], bird["x2"], bird["y2"]), w, h, margin)
                    if x2 <= x1 or y2 <= y1 or not detection.wanted(bird, classes, conf):
                        continue
                    crops.append(prepared(pixels[y1:y2, x1:x2]))
                    owners.append((row, bird))
                    if len(crops) * crops[0].nbytes >= batch_bytes:
                        answer()
                if len(waiting) >= WAITING and crops:
                    answer()
                if not crops and len(waiting) >= WAITING // 8:
                    yield handed_on()
        if crops:
            answer()
        if waiting:
            yield handed_on()

    return detection.pixel_columns(images).mapInArrow(batches, CLASSIFIED)


def detections(found: DataFrame) -> DataFrame:
    """A row a classified box: ``image, det, x1, y1, x2, y2, conf, cls, n_eyes, logits``; boxes without logits too."""
    b = F.col("_b")
    boxes = [b[c].alias(c) for c in ("x1", "y1", "x2", "y2", "conf", "cls")]
    return found.select(F.col("path").alias("image"), F.explode("birds").alias("_b")).select("image", b["ord"].alias("det"), *boxes, F.size(b["eyes"]).alias("n_eyes"), b["logits"].alias("logits"))


def candidates(boxes: DataFrame, species: DataFrame, k: int = TOP) -> DataFrame:
    """IMG11: ``image, det, rank, idx, confidence`` and the names of the ``k`` likeliest species of each box.

    ``species(idx, chinese_name, english_name, scientific_name)``, one row an index;
    classes beyond that table are left out, the others keep their rank. Confidence is
    rounded to four places.
    """
    top = refine.softmax_top(boxes.filter(F.size("logits") > 0).select("image", "det", "logits"), k, "logits")
    named = top.join(species.select("idx", "chinese_name", "english_name", "scientific_name"), "idx")
    return named.select("image", "det", "rank", "idx", F.round("p", 4).alias("confidence"), "chinese_name", "english_name", "scientific_name")


def shown_name(row: Column) -> Column:
    """The first name of a candidate that isn't empty."""
    return F.coalesce(*[F.nullif(row[c], F.lit("")) for c in ("chinese_name", "english_name", "scientific_name")], F.lit(UNKNOWN_NAME))


def _best(rows: DataFrame, order: str, prefix: str) -> DataFrame:
    """Number of candidates of each detection, and the name and confidence of the first."""
    first = F.min_by(F.struct("confidence", shown_name({c: F.col(c) for c in ("chinese_name", "english_name", "scientific_name")}).alias("name")), order)
    best = rows.groupBy("image", "det").agg(F.count(F.lit(1)).alias(f"{prefix}_count"), first.alias("_first"))
    return best.select("image", "det", f"{prefix}_count", F.col("_first.name").alias(f"{prefix}_top_name"), F.col("_first.confidence").alias(f"{prefix}_top_confidence"))


def outcomes(boxes: DataFrame, raw: DataFrame, refined: DataFrame, floor: float | None = None, subjects: DataFrame | None = None) -> DataFrame:
    """IMG12: for every detection what the candidates came to, and why there is none if so.

    ``raw`` and ``refined`` are candidates before and after :func:`refine.refined`.
    Adds counts, first names and confidences of both, ``unknown_reason`` (see
    :func:`refine.accepted`), ``detail`` with the figures of it, and ``accepted``.
    ``subjects(image, det, is_bird)`` names answers about other subjects, which the
    floor spares. Each side is aggregated before it is joined.
    """
    df = boxes.select("image", "det").join(_best(raw, "rank", "raw"), ["image", "det"], "left").join(_best(refined, "new_rank", "post"), ["image", "det"], "left")
    if subjects is None:
        df = df.withColumn("is_bird", F.lit(True))
    else:
        df = df.join(subjects.groupBy("image", "det").agg(F.min("is_bird").alias("is_bird")), ["image", "det"], "left").withColumn("is_bird", F.coalesce("is_bird", F.lit(True)))
    df = df.withColumns({"raw_count": F.coalesce("raw_count", F.lit(0)), "post_count": F.coalesce("post_count", F.lit(0)), "top_confidence": F.col("post_top_confidence")})
    judged = refine.accepted(df, floor).drop("top_confidence")
    if floor is None:
        return judged.withColumn("detail", F.col("unknown_reason"))
    figures = F.when(F.col("unknown_reason") == "top1_conf_below_min_accept", F.format_string("%s (%.3f < %.3f)", "unknown_reason", "post_top_confidence", F.lit(floor)))
    below = F.when(F.col("unknown_reason") == "all_candidates_filtered_below_unknown_kind_threshold", F.format_string("%s (< %.3f)", "unknown_reason", F.lit(floor)))
    return judged.withColumn("detail", F.coalesce(figures, below, "unknown_reason"))
