"""Focus of burst frames: which files to open, what is measured in them, and estimates for the rest.

The plan is made on the listing alone, before a pixel is read. Only the files that
it names are decoded; detector, outlines and sharpness are one pass over each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numbers import keep_quota, sharpness_blend
from . import burst, detection, focus

#: Fixed value: pixels of the smallest subject that counts.
MIN_AREA = 1000
#: Paths that are sent to all executors, so that contents stay where they are: some 50 MB.
BROADCAST_PATHS = 500_000

MEASURED = f"path string, birds {detection.BIRDS}, error string, decoded boolean, terms struct<lap_var:double,tenengrad:double,centre:double,penalty:double>"


def planned(bursts: DataFrame, detecting: bool, fast: bool = False, ratio: float = 0.2, least: int = 2) -> DataFrame:
    """IMG7: adds ``at``, ``sampled`` and ``plan`` to sessions: ``whole``, ``measure`` or ``estimate``.

    Without a detector, bursts whose quota is their size are kept ``whole``, unopened,
    and with ``fast`` only sampled frames of the others are measured. With one, every
    frame is: a neighbour's score says nothing about a subject.
    """
    df = burst.sampled(bursts)
    if detecting:
        return df.withColumns({"sampled": F.lit(True), "plan": F.lit("measure")})
    df = df if fast else df.withColumn("sampled", F.lit(True))
    whole = (F.col("n") > 1) & (keep_quota(F.col("n"), ratio, least) >= F.col("n"))
    return df.withColumn("plan", F.when(whole, "whole").when(F.col("sampled"), "measure").otherwise("estimate"))


def only(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files whose path is in the only column of ``paths``.

    Few paths are sent to the files; more are joined in a shuffle, before which Spark's
    runtime filter drops most contents that aren't asked for.
    """
    few = paths.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
    return files.join(F.broadcast(paths) if few else paths, "path", "left_semi")


def measured(
    files: DataFrame, decoder: Callable[[], Callable], birds: Callable[[], detection.Detector] | None = None, eyes: Callable[[], detection.Detector] | None = None,
    conf: float = detection.BIRD_CONFIDENCE, eye_conf: float = detection.EYE_CONFIDENCE, classes: tuple[int, ...] | None = (detection.BIRD_CLASS,), min_area: float = MIN_AREA, mode: str = "mask_hybrid",
) -> DataFrame:
    """IMG6, IMG8, IMG9: boxes and raw sharpness terms of ``files(path, content)``, one pass each.

    ``decoder()`` makes ``decode(bytes) -> pixels`` (BGR, or None) once a task. With a
    detector the terms are those of the largest subject, by its outline where it has
    one, and null where none reaches ``min_area``; without one, of the whole image.
    Files that can't be decoded have no boxes and null terms; faults are told in ``error``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(MEASURED))

    def batches(source):
        import pyarrow as pa

        decode, bird_model, eye_model = decoder(), birds() if birds else None, eyes() if eyes and birds else None

        def one(path: str, content: bytes) -> dict:
            out = {"path": path, "birds": [], "error": None, "decoded": False, "terms": None}
            try:
                pixels = decode(content) if content else None
            except Exception as e:  # noqa: BLE001  a file that can't be decoded costs itself only
                return out | {"error": f"{type(e).__name__}: {e}"}
            if pixels is None or not pixels.size:
                return out
            out["decoded"] = True
            terms = None
            if bird_model is None:
                terms = focus.subject_terms(pixels, mode=mode)
            else:
                out["birds"], out["error"] = detection.found_in(pixels, bird_model, eye_model, conf, eye_conf, classes, detection.EYE_MARGIN)
                size = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
                best = max((b for b in out["birds"] if detection.wanted(b, classes, conf)), key=size, default=None)
                if best is not None and size(best) >= min_area:
                    terms = focus.subject_terms(pixels, (best["x1"], best["y1"], best["x2"], best["y2"]), best["mask"], mode)
            return out | {"terms": terms and dict(zip(("lap_var", "tenengrad", "centre", "penalty"), terms, strict=True))}

        for batch in source:
            yield pa.RecordBatch.from_pylist([one(p.as_py(), c.as_py()) for p, c in zip(batch.column(0), batch.column(1), strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(batches, MEASURED)


def evaluated(
    bursts: DataFrame, files: DataFrame, decoder: Callable[[], Callable], birds: Callable[[], detection.Detector] | None = None, eyes: Callable[[], detection.Detector] | None = None,
    fast: bool = False, ratio: float = 0.2, least: int = 2, min_area: float = MIN_AREA, mode: str = "mask_hybrid",
) -> DataFrame:
    """IMG7: sessions with ``plan``, ``focus``, ``area``, boxes, eyes and ``keep``.

    ``bursts`` are rows of :func:`burst.sessions` without those columns, ``files`` the
    ``path`` and ``content`` of all files, of which only those planned to be measured are
    decoded. A path that occurs again takes the same measurement; one without a file,
    or a file that can't be decoded, has a focus of 0. Frames below ``min_area`` are
    never kept where a detector runs; without one, ``whole`` bursts keep all.
    """
    plan = planned(bursts, birds is not None, fast, ratio, least)
    wanted = plan.filter("plan = 'measure'").select("path").distinct()
    found = measured(only(files, wanted), decoder, birds, eyes, min_area=min_area, mode=mode)
    t = F.col("terms")
    score = t["lap_var"] if mode == "laplacian" else sharpness_blend(t["lap_var"], t["tenengrad"], t["centre"], t["penalty"])
    facts = detection.screened(found).withColumn("focus", F.coalesce(score, F.lit(0.0))).select("path", "focus", "area", "n_birds", "n_eyes", "has_eye", "birds", "error", "decoded")
    facts = facts.groupBy("path").agg(*[F.first(c).alias(c) for c in facts.columns if c != "path"])
    df = plan.join(facts, "path", "left").withColumns({"focus": F.coalesce("focus", F.when(F.col("plan") == "measure", 0.0)), "area": F.coalesce("area", F.lit(0.0)), "has_eye": F.coalesce("has_eye", F.lit(False))})
    df = burst.estimated(df).withColumn("focus", F.when(F.col("plan") == "whole", 0.0).otherwise(F.col("est_focus"))).drop("est_focus")
    kept = burst.best_frames(df, ratio, least, min_area if birds else None)
    return kept.withColumn("keep", F.col("keep") | (F.col("plan") == "whole"))
