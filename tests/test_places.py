"""The geocode cascade as one call, its dictionary between runs, and positions of photos."""

import struct

from plumage.sources import geocoders, images, places, sinks

KEYWORDS = [("杭州", "Hangzhou")]


def asked(log):
    def factory():
        def transport(url, params):
            name = next(iter(params.values()))
            with open(log, "a") as file:
                file.write(name + "\n")
            if name in ("Hangzhou Lake", "West") and "open-meteo" in url:
                return {"results": [{"latitude": 30.0, "longitude": 120.0}]}
            if "photon" in url:
                raise TimeoutError("slow")
            return {}

        return transport

    return factory


def test_cascade_asks_once_and_remembers(spark, tmp_path):
    root, log = str(tmp_path / "places"), str(tmp_path / "asked")
    places.add_places(spark.createDataFrame([("Home", 1.0, 2.0), ("Home2", None, 2.0), (None, 1.0, 1.0)], places.SCHEMA), root)
    names = spark.createDataFrame([(1, "Home"), (2, " 'Home' "), (3, "30.5, 120.25"), (4, "West"), (5, '"West"'), (6, "杭州湖"), (7, "nowhere"), (8, None), (9, ""), (10, "West")], "k int, name string")
    translations = spark.createDataFrame([("杭州湖", "Hangzhou Lake")], "zh string, en string")
    enabled = ("open-meteo", "photon")
    out = {r.k: r for r in geocoders.geocode(names, root, asked(log), KEYWORDS, translations, enabled=enabled).collect()}
    assert {k: (r.lat, r.lon, r.tier) for k, r in out.items()} == {
        1: (1.0, 2.0, "dictionary"), 2: (1.0, 2.0, "dictionary"), 3: (30.5, 120.25, "literal"), 4: (30.0, 120.0, "open-meteo"), 5: (30.0, 120.0, "open-meteo"),
        6: (30.0, 120.0, "open-meteo"), 7: (None, None, None), 8: (None, None, None), 9: (None, None, None), 10: (30.0, 120.0, "open-meteo"),
    }
    assert [(f.tier, f.fault) for f in out[7].faults] == [("photon", "TimeoutError: slow")] and out[4].faults == []
    first = sorted(line.strip() for line in open(log))
    assert first == sorted(["West", "Hangzhou Lake", "nowhere", "nowhere"])
    again = geocoders.geocode(names, root, asked(log), KEYWORDS, translations, enabled=enabled)
    assert {r.k: r.tier for r in again.collect()}[6] == "dictionary"
    assert len(open(log).readlines()) == len(first) + 2  # only the name that nobody knows is asked again
    assert [tuple(r) for r in geocoders.fault_counts(again).collect()] == [("photon", "TimeoutError: slow", 1)]
    assert {r.k for r in geocoders.geocode(names, root, None, KEYWORDS, translations).filter("tier is not null").collect()} == {1, 2, 3, 4, 5, 6, 10}


def test_runs_that_write_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "places")
    row = lambda name, lat: spark.createDataFrame([(name, lat, 0.5)], places.SCHEMA)
    first = places.add_places(row("a", 1.0), root)
    monkeypatch.setattr(places, "versions", lambda *_: [first])  # both runs look before either has written
    one, two = places.add_places(row("b", 2.0), root), places.add_places(row("c", 3.0), root)
    monkeypatch.undo()
    assert one.split("-")[0] == two.split("-")[0] == "00000002" and places.versions(spark, root) == [first, *sorted([one, two])]
    assert {r.name: r.lat for r in places.places(spark, root).collect()} == {"a": 1.0, "b": 2.0, "c": 3.0}
    places.add_places(row("a", 9.0), root)
    assert {r.name: r.lat for r in places.places(spark, root).collect()}["a"] == 1.0  # the oldest counts
    assert {r.name for r in places.places(spark, root, first).collect()} == {"a"} and places.places(spark, str(tmp_path / "none")).count() == 0
    row("d", 4.0).write.parquet(f"{root}/data/00000009-torn")  # a run that ended before its switch
    assert "d" not in {r.name for r in places.places(spark, root).collect()}


def test_positions_from_exif_else_xmp(spark):
    plain = b"\xff\xd8\xff\xdb\0\4ab\xff\xda\0\2scan\xff\xd9"
    xmp = b"\xff\xfe<exif:GPSLatitude>12.5</exif:GPSLatitude><exif:GPSLatitudeRef>S</exif:GPSLatitudeRef><exif:GPSLongitude>100.25</exif:GPSLongitude>\x80"
    both = sinks.with_gps(plain, 30.0, -120.0, 7.0)
    cut = sinks.with_exif(plain, b"MM\0*" + struct.pack(">I", 9000))
    rows = [("exif", both), ("xmp", plain + xmp), ("both", both + xmp), ("none", plain), ("cut", cut + xmp), ("empty", b""), ("null", None)]
    files = spark.createDataFrame([(p, 0 if c is None else len(c), c) for p, c in rows], "path string, length long, content binary")
    got = {r.path: (r.origin, r.lat and round(r.lat, 4), r.lon and round(r.lon, 4), r.altitude) for r in images.positioned(files).collect()}
    assert got == {"exif": ("exif", 30.0, -120.0, 7.0), "xmp": ("xmp", -12.5, 100.25, None), "both": ("exif", 30.0, -120.0, 7.0), "none": (None,) * 4, "cut": ("xmp", -12.5, 100.25, None), "empty": (None,) * 4, "null": (None,) * 4}
