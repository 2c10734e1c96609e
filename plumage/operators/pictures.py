"""Pictures with frames, captions, logos and labelled boxes, drawn in tasks from column geometry.

All places come from :mod:`plumage.functions.layout`; kernels only paint them. Letters
are the caller's: ``writer()`` makes ``write(canvas, x, y, text, size, colour)`` once a
task, which paints into the array, with ``x`` and ``y`` as the text's upper left corner.
Arrays are RGB bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.text import suffix

#: The part of a logo's own alpha that shows, and colours of boxes, eyes and species.
LOGO_ALPHA = 0.92
BIRD_COLOUR, EYE_COLOUR, SPECIES_COLOUR, GROUND = (50, 210, 50), (255, 50, 50), (255, 220, 0), (0, 0, 0)


def with_geometry(pictures: DataFrame, widths: dict[str, float] | None = None, logo: tuple[int, int] | None = None, share: float = 0.30) -> DataFrame:
    """IMG18: adds ``frame``, ``bar``, ``logo``, ``left_lines``, ``right_lines`` and ``right_widths`` to rows.

    ``pictures(width, height, left, right)``: a picture's size and its two captions.
    """
    w, h = F.col("width"), F.col("height")
    df = pictures.withColumn("frame", L.caption_frame(w, h))
    f = F.col("frame")
    lines = lambda c: L.wrapped(F.col(c), f["half_width"], f["font_size"], widths)
    df = df.withColumns({"left_lines": lines("left"), "right_lines": lines("right")})
    df = df.withColumns({"bar": L.caption_bar(f, F.col("left_lines"), F.col("right_lines")), "right_widths": F.transform("right_lines", lambda t: L.text_width(t, f["font_size"], widths))})
    place = L.logo_place(f, w, h, F.lit(logo[0]), F.lit(logo[1]), share) if logo else F.lit(None).cast("struct<x:int,y:int,width:int,height:int>")
    return df.withColumn("logo", place)


def framed(pixels, geometry: dict, write: Callable, logo=None):
    """IMG18: one picture on its canvas: white margin, gray line, captions, and the logo's shape in black or white."""
    import numpy as np

    from .recognition import resized

    f, bar = geometry["frame"], geometry["bar"]
    h, w = pixels.shape[:2]
    side = f["side"]
    canvas = np.full((bar["canvas_height"], f["canvas_width"], 3), 255, np.uint8)
    canvas[side : side + h + 2, side : side + w + 2] = L.GRAY
    canvas[side + 1 : side + 1 + h, side + 1 : side + 1 + w] = pixels
    canvas[f["bar_top"]] = L.GRAY
    step = bar["line_height"] + bar["line_gap"]
    for i, line in enumerate(geometry["left_lines"]):
        write(canvas, f["pad_x"], bar["text_top"] + i * step, line, f["font_size"], L.TEXT)
    for i, (line, wide) in enumerate(zip(geometry["right_lines"], geometry["right_widths"], strict=True)):
        write(canvas, int(f["canvas_width"] - f["pad_x"] - wide), bar["text_top"] + i * step, line, f["font_size"], L.TEXT)
    at = geometry["logo"]
    if logo is not None and at is not None and at["width"] > 0 and at["height"] > 0:
        shape = np.repeat(logo[:, :, 3:4], 3, axis=2)
        alpha = np.floor(resized(shape, at["height"], at["width"])[:, :, :1] * LOGO_ALPHA) / 255.0
        x, y = at["x"], max(0, at["y"])
        ground = canvas[y : min(y + at["height"], side + 1 + h), x : min(x + at["width"], side + 1 + w)]
        alpha = alpha[: ground.shape[0], : ground.shape[1]]
        luma = float((ground @ np.array((0.299, 0.587, 0.114))).mean()) if ground.size else 0.0
        ink = L.DARK if luma >= L.NEAR_WHITE else L.LIGHT
        ground[:] = np.rint(ground * (1 - alpha) + np.array(ink) * alpha).astype(np.uint8)
    return canvas


def outlined(canvas, box: tuple, colour: tuple, line: int) -> None:
    """IMG13: a rectangle of some width with a black rim, cut at the picture."""
    h, w = canvas.shape[:2]

    def ring(d: int, ink: tuple) -> None:
        x1, y1, x2, y2 = box[0] - d, box[1] - d, box[2] + d, box[3] + d
        xs, ys = slice(max(0, x1), max(0, min(w, x2 + 1))), slice(max(0, y1), max(0, min(h, y2 + 1)))
        for y in (y1, y2):
            if 0 <= y < h:
                canvas[y, xs] = ink
        for x in (x1, x2):
            if 0 <= x < w:
                canvas[ys, x] = ink

    for d in range(line + 2):
        ring(d, GROUND)
    for d in range(line):
        ring(d // 2, colour)


def annotated(pixels, sizes: dict, boxes: list[dict], write: Callable):
    """SNK7, IMG13: a copy of a picture with its boxes, eyes and labels.

    ``boxes`` have corners, ``text``, ``known``, the place of the label (``x, y, w, h``)
    and ``eyes`` with corners.
    """
    canvas = pixels.copy()
    h, w = canvas.shape[:2]
    for b in boxes:
        outlined(canvas, (b["x1"], b["y1"], b["x2"], b["y2"]), BIRD_COLOUR, sizes["bird_line"])
        at = b["label"]
        canvas[max(0, at["y"]) : min(h, at["y"] + at["h"]), max(0, at["x"] - sizes["pad"]) : min(w, at["x"] + at["w"])] = GROUND
        write(canvas, at["x"], at["y"] + sizes["pad"], b["text"], sizes["main_size"], SPECIES_COLOUR if b["known"] else BIRD_COLOUR)
        for e in b["eyes"]:
            outlined(canvas, (int(e["x1"]), int(e["y1"]), int(e["x2"]), int(e["y2"])), EYE_COLOUR, sizes["eye_line"])
    return canvas


def label_text(name: Column, confidence: Column, ordinal: Column) -> Column:
    """IMG13: a species and how sure it is, else the box's number."""
    return F.when(F.coalesce(name, F.lit("")) != "", F.format_string("%s  %.1f%%", name, confidence * 100)).otherwise(F.concat(F.lit("Bird "), (ordinal + 1).cast("string")))


def _drawn(rows: DataFrame, decoder, encoder, paint: Callable) -> DataFrame:
    """``(dest, content, error)``: each row's file decoded once, painted and encoded."""

    def batches(source):
        import pandas as pd

        decode, encode, draw = decoder(), encoder(), paint()
        for pdf in source:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    pixels = decode(bytes(row["content"]))
                    if pixels is None:
                        raise ValueError("not decoded")
                    out.append((row["dest"], encode(draw(pixels[:, :, 2::-1], row)[:, :, ::-1]), None))
                except Exception as e:  # noqa: BLE001  a picture that fails is told
                    out.append((row["dest"], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["dest", "content", "error"])

    return rows.mapInPandas(batches, "dest string, content binary, error string")


def captioned(files: DataFrame, captions: DataFrame, decoder, encoder, writer, logo=None, tone: dict | None = None, widths: dict[str, float] | None = None, share: float = 0.30) -> DataFrame:
    """SNK11, SNK12, IMG18: ``(dest, content, error)`` of ``files(path, content)`` framed with ``captions``.

    ``captions(path, dest, width, height, left, right)`` are the pictures to make, with
    their sizes; ``dest`` comes from :func:`archive.collision_names`. ``logo`` is an RGBA
    array, ``tone`` the arguments of :func:`development.toned`. A single row is a preview.
    Hand the rows to ``files.write_files``, whose rows count what was written.
    """
    from .development import toned
    from .evaluation import only

    planned = with_geometry(captions, widths, None if logo is None else (logo.shape[1], logo.shape[0]), share)
    rows = only(files.select("path", "content"), planned.select("path").distinct()).join(planned.drop("width", "height", "left", "right"), "path")

    def paint():
        write = writer()

        def draw(pixels, row):
            return framed(toned(pixels, **tone) if tone else pixels, row, write, logo)

        return draw

    return _drawn(rows, decoder, encoder, paint)


def with_boxes(files: DataFrame, boxes: DataFrame, decoder, encoder, writer, widths: dict[str, float] | None = None) -> DataFrame:
    """SNK7: ``(dest, content, error)`` of ``files(path, content)`` with their ``boxes`` drawn.

    ``boxes(path, width, height, ord, x1, y1, x2, y2, name, confidence, eyes)``, one row a
    box; labels keep apart in the order of ``ord``. Targets are ``detected_`` and the stem.
    """
    from .evaluation import only

    sizes = L.label_sizes(F.col("width"), F.col("height"))
    one = F.struct("ord", "x1", "y1", "x2", "y2", label_text(F.col("name"), F.col("confidence"), F.col("ord")).alias("text"), (F.coalesce("name", F.lit("")) != "").alias("known"), "eyes")
    df = boxes.groupBy("path").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.array_sort(F.collect_list(one)).alias("boxes")).withColumn("sizes", sizes)  # as many as one image has
    s = F.col("sizes")
    label = lambda b: F.struct(b["x1"].alias("x1"), b["y1"].alias("y1"), b["y2"].alias("y2"), L.text_width(b["text"], s["main_size"], widths).cast("int").alias("text_w"), (s["main_size"] + 2 * s["pad"]).alias("label_h"))
    df = df.withColumn("_at", L.labels_apart(F.transform("boxes", label), F.col("width"), F.col("height"), s["pad"], s["gap"]))
    df = df.withColumn("boxes", F.zip_with("boxes", "_at", lambda b, at: b.withField("label", at))).drop("_at")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    df = df.withColumn("dest", F.concat(F.lit("detected_"), stem, F.lit(".jpg")))
    rows = only(files.select("path", "content"), df.select("path")).join(df.select("path", "dest", "sizes", "boxes"), "path")

    def paint():
        write = writer()
        return lambda pixels, row: annotated(pixels, row["sizes"], list(row["boxes"]), write)

    return _drawn(rows, decoder, encoder, paint)


def flat_targets(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """SNK11, WIN7: ``dest`` of files that go to one folder under their own names, dodging each other and what is there."""
    from .archive import collision_names

    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    split = files.withColumns({"stem": F.regexp_replace(name, r"\.[^.]*$", ""), "ext": F.when(ext == "", ".jpg").otherwise(ext)})
    return collision_names(split, existing).withColumnRenamed("target", "dest").drop("stem", "ext")


def first_with_images(spark, folders: list[str], suffixes: tuple[str, ...]) -> str | None:
    """SRC34: the first folder that exists and holds an image at any depth, else the last one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in [f for f in folders if f]:
        system = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(hadoop(folder)):
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").filter(suffix(F.col("path")).isin(*suffixes))
        if not found.isEmpty():
            return folder
    return folders[-1] if folders else None
