"""EXIF, XMP, images, dimensions, connectors and file plans on small files."""

import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from plumage.operators import focus
from plumage.sources import dimensions, geocoders, images, sinks


def png(path, x):
    h, w = x.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in x.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def tiff_with_time(text):
    data = text.encode() + b"\0"
    exif_at, data_at = 26, 44
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<HHHII", 1, 0x8769, 4, 1, exif_at) + b"\0" * 4 + struct.pack("<HHHII", 1, 0x9003, 2, len(data), data_at) + b"\0" * 4 + data


def test_capture_times(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff_with_time("2024:02:03 04:05:06")) + 8) + b"Exif\0\0" + tiff_with_time("2024:02:03 04:05:06") + b"\xff\xda")
    (tmp_path / "b.tif").write_bytes(tiff_with_time("2024:13:02 00:00:00"))
    (tmp_path / "c.JPG").write_bytes(b"junk")
    (tmp_path / "d.txt").write_bytes(b"")
    rows = images.with_exif(images.contents(spark, str(tmp_path)))
    times = rows.select("path", (images.capture_time(F.col("exif_original"), F.col("exif_digitized"), F.col("exif_datetime"), F.lit(None).cast("timestamp"))).cast("string").alias("t"))
    assert {r.path[-5:]: r.t for r in times.collect()} == {"a.jpg": "2024-02-03 04:05:06", "b.tif": None, "c.JPG": None}
    assert images.listing(spark, str(tmp_path)).count() == 3


def test_positions_round_trip(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02rest"
    rows = spark.createDataFrame([("a", jpeg, -33.856784, 151.215297), ("b", b"no", 1.0, 1.0)], "path string, content binary, lat double, lon double")
    out = {r.path: r for r in sinks.gps_written(rows).collect()}
    assert out["a"].ok and not out["b"].ok and bytes(out["a"].content).endswith(jpeg[2:])
    files = spark.createDataFrame([("a", None, 1, out["a"].content)], "path string, modificationTime timestamp, length long, content binary")
    at = images.with_exif(files).select(images.position(F.col("lat"), F.col("lat_ref"), F.col("lon"), F.col("lon_ref")).alias("p")).first().p
    assert abs(at.lat + 33.856784) < 1e-5 and abs(at.lon - 151.215297) < 1e-5
    again = sinks.with_gps(bytes(out["a"].content), 1.0, 2.0)
    assert again.count(b"Exif\0\0") == 1


def test_positions_keep_other_tags(spark):
    tiff = tiff_with_time("2024:02:03 04:05:06")
    payload = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + (len(payload) + 2).to_bytes(2, "big") + payload + b"\xff\xda\x00\x02rest"
    for once in (sinks.with_gps(jpeg, 1.5, -2.5, -7.0), sinks.with_gps(sinks.with_gps(jpeg, 9.0, 9.0), 1.5, -2.5, -7.0)):
        before, after = images.exif_row(jpeg), images.exif_row(once)
        changed = {k for k in after if after[k] != before.get(k)} if isinstance(after, dict) else None
        assert once.count(b"Exif\0\0") == 1 and once.endswith(b"rest")
        assert changed is None or changed <= {"lat", "lon", "lat_ref", "lon_ref", "alt"}
    files = spark.createDataFrame([("a", None, 1, bytearray(once))], "path string, modificationTime timestamp, length long, content binary")
    row = images.with_exif(files).select("exif_original", "exif_datetime", images.position(F.col("lat"), F.col("lat_ref"), F.col("lon"), F.col("lon_ref")).alias("p")).first()
    assert "2024:02:03 04:05:06" in (row.exif_original, row.exif_datetime) and (row.p.lat, row.p.lon) == (1.5, -2.5)


def test_exif_walk_survives_garbage():
    import random

    rng = random.Random(3)
    good = tiff_with_time("2024:02:03 04:05:06")
    for _ in range(500):
        data = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            images.exif_row(bytes(data[: rng.randint(0, len(data))]))
        except RecursionError:
            raise
    assert images.exif_row(None)[0] is None


def test_xmp(spark):
    xml = lambda lat, ref, lon: f"<exif:GPSLatitude>{lat}</exif:GPSLatitude><exif:GPSLatitudeRef>{ref}</exif:GPSLatitudeRef><exif:GPSLongitude>{lon}</exif:GPSLongitude><exif:GPSLongitudeRef>WEST</exif:GPSLongitudeRef>".encode()
    rows = [(1, xml("30.5", "N", "10")), (2, xml("30,30,0", "South", "10，6，0")), (3, xml("95", "N", "10")), (4, b"nothing"), (5, xml("x", "N", "1"))]
    df = spark.createDataFrame(rows, "id int, content binary").withColumn("t", images.xmp_text(F.col("content"), F.length("content")))
    got = {r.id: r.p and (round(r.p.lat, 6), round(r.p.lon, 6)) for r in df.select("id", images.xmp_position(F.col("t")).alias("p")).collect()}
    assert got == {1: (30.5, -10.0), 2: (-30.5, -10.1), 3: None, 4: None, 5: None}


def test_focus_prefers_sharp_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    sharp = np.repeat(rng.integers(0, 255, (48, 64, 1)), 3, axis=2)
    blurred = sharp.astype(float)
    for _ in range(6):
        blurred = (blurred + np.roll(blurred, 1, 0) + np.roll(blurred, 1, 1) + np.roll(blurred, (1, 1), (0, 1))) / 4
    png(tmp_path / "sharp.png", sharp)
    png(tmp_path / "soft.png", blurred)
    (tmp_path / "bad.png").write_bytes(b"no image")
    got = {r.path.rsplit("/")[-1]: r for r in focus.scored(images.decoded(spark, str(tmp_path), drop_invalid=False)).collect()}
    assert got["sharp.png"].focus > got["soft.png"].focus > 0 and got["bad.png"].focus == 0.0
    gray = focus.gray_of(sharp[:, :, ::-1].astype(np.uint8).tobytes(), 48, 64, 3)
    assert abs(got["sharp.png"].lap_var - focus.laplacian(gray).var()) < 1e-6


def test_kernels_on_known_values():
    flat, ramp = np.full((9, 9), 7.0), np.tile(np.arange(9.0), (9, 1))
    assert focus.focus_terms(flat) == (0.0, 0.0, 0.0, 0.0)
    assert np.allclose(focus.gradient(ramp)[1:-1, 1:-1], 8) and np.allclose(focus.laplacian(ramp)[:, 1:-1], 0)
    spike = np.zeros((5, 5))
    spike[2, 2] = 1
    assert focus.laplacian(spike)[2, 2] == -4 and focus.laplacian(spike)[1, 2] == 1
    mask = focus.polygon_mask([(2, 2), (20, 2), (20, 20), (2, 20)], 30, 30)
    assert mask.sum() == 19 * 19 and focus.polygon_mask([(0, 0), (1, 1)], 30, 30) is None and focus.polygon_mask([(0, 0), (3, 0), (3, 3)], 30, 30) is None
    assert focus.mask_terms(np.random.default_rng(0).random((30, 30)), mask) is not None


def test_dimension_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([["a", "A", "Aa aa"], ["b"], "junk", ["c", None, " "]]))
    assert [tuple(r) for r in dimensions.species_list(spark, str(tmp_path / "s.json")).collect()] == [(0, "a", "A", "Aa aa"), (1, "b", "", ""), (3, "c", "", "")]
    square = [[0, 0], [2, 0], [2, 2], [0, 2]]
    features = [{"properties": {"name": "P"}, "geometry": {"type": "Polygon", "coordinates": [square, [[1, 1], [1.5, 1], [1, 1.5]]]}}, {"properties": {"name": "M"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}, {"properties": {"name": "X"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    (tmp_path / "g.json").write_text(json.dumps({"features": features}))
    rows = dimensions.polygons(spark, str(tmp_path / "g.json")).collect()
    assert [(r.name, r.part, len(r.ring)) for r in rows] == [("P", 0, 4), ("M", 0, 4), ("M", 1, 4)]
    assert [tuple(r) for r in dimensions.named_points(spark, str(tmp_path / "g.json")).collect()] == [("X", 1.0, 2.0)]
    (tmp_path / "r.json").write_text(json.dumps({"code_mapping": {"x": 1}, "regions": {"CN-1": {"name": "n", "species": ["x", "y"]}}}))
    regions, codes = dimensions.region_index(spark, str(tmp_path / "r.json"))
    assert sorted(r.species_code for r in regions.collect()) == ["x", "y"] and [tuple(r) for r in codes.collect()] == [("x", 1)]


def test_online_tiers(spark):
    def factory():
        def transport(url, params):
            if "amap" in url:
                return {"status": "1", "geocodes": [{"location": "120.5,30.5"}]} if params["address"] == "here" else {"status": "0"}
            if "open-meteo" in url:
                return {"results": [{"latitude": 8.0 if params["name"] == "there-en" else 0.0, "longitude": 5.0}]}  # an exact 0 is no answer there
            raise OSError("down")

        return transport

    names = spark.createDataFrame([("here", "here"), ("there", "there-en"), ("nowhere", None), ("here", "here")], "name string, query_name string")
    rows = geocoders.geocode_online(names, factory).collect()
    got = {r.name: (r.lat, r.lon, r.tier) for r in rows}
    assert got == {"here": (30.5, 120.5, "amap"), "there": (8.0, 5.0, "open-meteo"), "nowhere": (None, None, None)}
    assert {r.name: [f.tier for f in r.faults] for r in rows} == {"here": [], "there": ["tencent", "baidu"], "nowhere": ["tencent", "baidu", "photon", "nominatim"]}


def test_copies_and_usage(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1")
    plan = spark.createDataFrame([(str(tmp_path / "a"), "x/y/a"), (str(tmp_path / "none"), "x/none")], "src string, dest string")
    assert tuple(sinks.written_count(sinks.copied(plan, str(tmp_path))).first()) == (1, 2) and (tmp_path / "x/y/a").read_bytes() == b"1"
    usage = spark.createDataFrame([("2024-01-01", "a", 1), ("2024-01-02", "a", 2)], "day string, model string, tokens long")
    sinks.write_usage(usage, str(tmp_path / "u"))
    sinks.write_usage(usage.filter("day = '2024-01-02'").withColumn("tokens", F.lit(9).cast("long")), str(tmp_path / "u"))
    assert sorted(r.tokens for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [1, 9]
