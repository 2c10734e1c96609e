"""The file sink: what failing and repeated tasks leave, and crops with their tags."""

import json
import os
import struct
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from plumage.sources import files, images, sinks

FLAKY = """
import json, os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from plumage.sources import files
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
mark = {mark!r}
def flaky(source):
    for pdf in source:
        yield pdf
    from pyspark import TaskContext
    if TaskContext.get().attemptNumber() == 0:
        open(os.path.join(mark, str(TaskContext.get().partitionId())), "w").close()
        raise RuntimeError("lost after all rows were handed on")
rows = spark.range(0, 40, 1, 4).selectExpr("concat('d', id % 7, '/f', id) AS dest", "cast(repeat(cast(id as string), 1000) as binary) AS content").mapInPandas(flaky, "dest string, content binary")
out = files.write_files(rows, {root!r})
print(json.dumps([[r.dest, r.ok, r.bytes] for r in out.collect()]))
"""


def everything(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names}


def test_tasks_that_fail_and_run_again_leave_each_file_once(tmp_path):
    root, mark = tmp_path / "root", tmp_path / "mark"
    root.mkdir(), mark.mkdir()
    script = FLAKY.format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), mark=str(mark), root=str(root))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    told = json.loads(done.stdout.strip().splitlines()[-1])
    assert len(os.listdir(mark)) == 4  # every task failed once, when all its files were staged
    assert sorted(told) == sorted([f"d{i % 7}/f{i}", True, 1000 * len(str(i))] for i in range(40))
    assert everything(root) == {f"d{i % 7}/f{i}": str(i).encode() * 1000 for i in range(40)}  # and nothing is left of the staging


def test_what_cant_be_written_is_told(spark, tmp_path):
    (tmp_path / "src").write_bytes(b"source")
    os.utime(tmp_path / "src", (1e9, 1e9))
    rows = spark.createDataFrame([("a/b", str(tmp_path / "src"), None), ("a/c", None, bytearray(b"")), ("a/d", str(tmp_path / "none"), None), ("e", None, None), ("../up", None, bytearray(b"x")), ("/abs", None, bytearray(b"x")), (None, None, bytearray(b"x")), ("twice", None, bytearray(b"one")), ("twice", None, bytearray(b"two"))], "dest string, src string, content binary")
    root = tmp_path / "root"
    root.mkdir()
    (root / "e").write_bytes(b"before")
    told = sorted((r.dest or "", r.ok, r.bytes, r.error) for r in files.write_files(rows, str(root)).collect())
    assert [t for t in told if t[0] != "twice"] == [("", False, None, "outside"), ("../up", False, None, "outside"), ("/abs", False, None, "outside"), ("a/b", True, 6, None), ("a/c", True, 0, None), ("a/d", False, None, "FileNotFoundError"), ("e", False, None, "nothing to write")]
    assert sorted((t[1], t[3]) for t in told if t[0] == "twice") == [(False, "repeated"), (True, None)]
    left = everything(root)
    assert left.pop("twice") in (b"one", b"two") and left == {"a/b": b"source", "a/c": b"", "e": b"before"} and os.path.getmtime(root / "a/b") == 1e9
    assert not (tmp_path / "up").exists()
    assert files.write_files(rows.filter("false"), str(root)).count() == 0


def jpeg(maker=None):
    body = b"MM\0*" + struct.pack(">I", 8)
    if maker is not None:
        body += struct.pack(">H", 2) + struct.pack(">HHII", 271, 2, len(maker) + 1, 38) + struct.pack(">HHII", 0x0112, 3, 1, 6 << 16) + b"\0\0\0\0" + maker + b"\0"
    plain = b"\xff\xd8\xff\xdb\0\4ab\xff\xda\0\2scan\xff\xd9"
    return plain if maker is None else sinks.with_exif(plain, body)


def test_crops_carry_tags_and_their_maker(spark, tmp_path):
    def decoder():
        return lambda content: None if b"none" in content else np.arange(20 * 30 * 3, dtype=np.uint8).reshape(20, 30, 3)

    def encoder():
        return lambda pixels: b"\xff\xd8\xff\xda\0\2" + bytes(pixels.shape[:2]) + b"\xff\xd9"

    photos = spark.createDataFrame([("p", jpeg(b"Camera of a maker")), ("q", jpeg()), ("r", b"none"), ("s", jpeg(b"x"))], "path string, content binary")
    crops = spark.createDataFrame([("p", "1.jpg", 5, 5, 15, 12), ("p", "2.jpg", -9, -9, 99, 99), ("p", "3.jpg", 40, 40, 50, 50), ("q", "4.jpg", 0, 0, 3, 2), ("r", "5.jpg", 0, 0, 3, 2)], "path string, dest string, x1 int, y1 int, x2 int, y2 int")
    got = {r.dest: r for r in files.cropped(photos, crops, decoder, encoder, b"cut by us").collect()}
    assert set(got) == {f"{i}.jpg" for i in range(1, 6)} and got["3.jpg"].error == "empty" and got["5.jpg"].error == "not decoded"
    first = bytes(got["1.jpg"].content)
    assert first.endswith(b"\xff\xda\0\2" + bytes((7, 10)) + b"\xff\xd9") and bytes(got["2.jpg"].content)[-4:-2] == bytes((20, 30))
    tags = {k[1] if isinstance(k, tuple) else k: v for k, v in images.exif_tags(first).items()}
    assert tags[271] == "cut by us" and tags[0x0112] == (6,)
    assert images.exif_tags(bytes(got["4.jpg"].content)) == {}
    out = files.write_files(files.cropped(photos, crops, decoder, encoder).filter("content is not null"), str(tmp_path)).collect()
    assert sum(r.ok for r in out) == 3 and (tmp_path / "1.jpg").read_bytes()[:2] == b"\xff\xd8"
    short = sinks.tiff_with_maker(images.exif_block(jpeg(b"Camera of a maker")), b"ab")
    assert {k[1] if isinstance(k, tuple) else k: v for k, v in images.exif_tags(short).items()}[271] == "ab"


def test_relative_names(spark):
    df = spark.createDataFrame([("file:/photos/a/b.jpg",), ("/photos/c.jpg",), ("/other/d.jpg",), ("\\photos\\e.jpg",)], "p string")
    assert [r[0] for r in df.select(files.relative(F.col("p"), "/photos")).collect()] == ["a/b.jpg", "c.jpg", "d.jpg", "e.jpg"]
