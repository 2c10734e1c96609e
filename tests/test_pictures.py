"""Frames, captions, logos and boxes as they are painted, and batches of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumage.functions import layout as L
from plumage.operators import detection, pictures
from plumage.sources import files, images

IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def block_writer():
    """Letters as blocks of their size."""

    def write(canvas, x, y, text, size, colour):
        canvas[y : y + size, x : x + int(len(text) * size * 0.5)] = colour

    return write


def decoder():
    return lambda content: None if content == b"none" else np.full((40, 60, 3), (10, 20, 30), np.uint8)


def encoder():
    return lambda pixels: np.array(pixels.shape, "<i4").tobytes() + np.ascontiguousarray(pixels).tobytes()


def decoded(content):
    shape = np.frombuffer(bytes(content)[:12], "<i4")
    return np.frombuffer(bytes(content)[12:], np.uint8).reshape(shape)[:, :, ::-1]


def test_framed_batch_with_names_and_counts(spark, tmp_path):
    photos = spark.createDataFrame([("/a/x.jpg", bytearray(b"1")), ("/b/x.jpg", bytearray(b"2")), ("/b/none.jpg", bytearray(b"none")), ("/b/other.jpg", bytearray(b"3"))], "path string, content binary")
    there = spark.createDataFrame([("x_1", ".jpg")], "stem string, ext string")
    wanted = pictures.flat_targets(photos.filter("path not like '%other%'").select("path"), there)
    captions = wanted.withColumns({"width": F.lit(60), "height": F.lit(40), "left": F.lit("bird  |  place"), "right": F.lit("1/500")})
    logo = np.zeros((10, 20, 4), np.uint8)
    logo[:, :, 3] = 255
    made = pictures.captioned(photos, captions, decoder, encoder, block_writer, logo, {"exposure": 100})
    rows = {r.dest: r for r in made.collect()}
    assert set(rows) == {"x.jpg", "x_2.jpg", "none.jpg"} and rows["none.jpg"].error == "ValueError: not decoded" and rows["none.jpg"].content is None
    picture = decoded(rows["x.jpg"].content)
    frame = spark.range(1).select(L.caption_frame(F.lit(60), F.lit(40)).alias("f")).first().f
    assert picture.shape[1] == frame.canvas_width and (picture[0, 0] == 255).all()
    side = frame.side
    assert tuple(picture[side, side]) == L.GRAY and tuple(picture[side + 1, side + 1]) == (45, 30, 15) and tuple(picture[side + 41, side + 5]) == L.GRAY  # toned, then framed
    assert tuple(picture[frame.bar_top, 0]) == L.GRAY and tuple(picture[frame.bar_top + frame.pad_y, frame.pad_x]) == L.TEXT
    assert (picture[frame.bar_top + 1 :, -frame.pad_x :] == 255).all()  # the right caption ends at the padding
    assert (picture[side + 1 : side + 41, side + 1 : side + 61] > 200).all(axis=2).sum() > 100  # a light logo on a dark picture
    told = files.write_files(made.filter("content is not null"), str(tmp_path))
    assert told.filter("ok").count() == 2 and (tmp_path / "x_2.jpg").exists()


def test_logo_on_a_light_ground_is_dark():
    light = np.full((100, 100, 3), 250, np.uint8)
    logo = np.full((5, 5, 4), 255, np.uint8)
    geometry = {"frame": {"side": 2, "canvas_width": 106, "bar_top": 104, "font_size": 18, "pad_x": 15, "pad_y": 12}, "bar": {"canvas_height": 150, "line_height": 20, "line_gap": 2, "text_top": 116}, "left_lines": [], "right_lines": [], "right_widths": [], "logo": {"x": 40, "y": 60, "width": 20, "height": 20}}
    out = pictures.framed(light, geometry, None, logo)
    assert out[70, 50].max() < 60 and out[70, 30].min() == 250 and (pictures.framed(light, geometry, None)[70, 50] == 250).all()


def test_boxes_and_labels(spark):
    def large():
        return lambda content: None if content == b"none" else np.full((400, 600, 3), (10, 20, 30), np.uint8)

    photos = spark.createDataFrame([("/a/x.raw.jpg", bytearray(b"1")), ("/a/y.jpg", bytearray(b"none"))], "path string, content binary")
    eye = [(0, 42.0, 152.0, 64.0, 164.0, 0.9, 0)]
    boxes = spark.createDataFrame([("/a/x.raw.jpg", 600, 400, 0, 20, 130, 85, 190, "gull", 0.876, eye), ("/a/x.raw.jpg", 600, 400, 1, 300, -5, 340, 40, None, None, []), ("/a/y.jpg", 600, 400, 0, 0, 0, 5, 5, "", 0.5, [])], f"path string, width int, height int, ord int, x1 int, y1 int, x2 int, y2 int, name string, confidence double, eyes array<{detection.EYE}>")
    rows = {r.dest: r for r in pictures.with_boxes(photos, boxes, large, encoder, block_writer).collect()}
    assert set(rows) == {"detected_x.raw.jpg", "detected_y.jpg"} and rows["detected_y.jpg"].error
    picture = decoded(rows["detected_x.raw.jpg"].content)
    colours = {tuple(int(v) for v in c) for c in picture.reshape(-1, 3)}
    assert {pictures.BIRD_COLOUR, pictures.EYE_COLOUR, pictures.SPECIES_COLOUR, pictures.GROUND} <= colours and picture.shape == (400, 600, 3)
    text = spark.createDataFrame([("gull", 0.876, 0), ("", 0.5, 2), (None, None, 4)], "n string, c double, o int").select(pictures.label_text(F.col("n"), F.col("c"), F.col("o")).alias("t")).collect()
    assert [r.t for r in text] == ["gull  87.6%", "Bird 3", "Bird 5"]


def test_outline_stays_inside():
    canvas = np.full((10, 10, 3), 9, np.uint8)
    for box in ((-20, -20, -10, -10), (30, 30, 40, 40), (-3, 2, 30, 5), (2, 2, 6, 6)):
        pictures.outlined(canvas, box, (1, 2, 3), 2)
    assert tuple(canvas[2, 3]) == (1, 2, 3) and canvas.shape == (10, 10, 3)


def test_first_folder_with_images(spark, tmp_path):
    for name, file in (("crops", "a.txt"), ("screened/deep", "b.JPG"), ("input", "c.jpg")):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / file).write_bytes(b"1")
    at = lambda n: str(tmp_path / n)
    pick = lambda *names: pictures.first_with_images(spark, [n and at(n) for n in names], (".jpg",))
    assert pick("crops", "screened", "input") == at("screened") and pick("none", "crops", "input") == at("input") and pick("", "none", "crops") == at("crops")
    assert pictures.first_with_images(spark, [], (".jpg",)) is None


def test_rgb_and_whole_images(spark):
    rows = spark.createDataFrame([(("a", 1, 2, 3, 16, bytearray(b"\1\2\3\4\5\6")),), (("g", 1, 2, 1, 0, bytearray(b"\7\x08")),)], IMAGE)
    got = {r.path: bytes(r.rgb) for r in images.as_rgb(rows).collect()}
    assert got == {"a": b"\3\2\1\6\5\4", "g": b"\7\7\7\x08\x08\x08"} and images.whole(rows).count() == 2
    bad = rows.unionByName(spark.createDataFrame([(("bad", -1, -1, -1, -1, bytearray(b"")),)], IMAGE))
    assert {r.path: r.rgb for r in images.as_rgb(bad).collect()}["bad"] is None
    with pytest.raises(Exception, match="not decoded: bad"):
        images.whole(bad).collect()
    listed = spark.createDataFrame([("b",), ("a",)], "path string")
    assert [r.path for r in images.in_order(listed).collect()] == ["a", "b"]
