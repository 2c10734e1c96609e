"""The report in parts: sections, cards, links to every page, escaping."""

import re

import numpy as np
from pyspark.sql import functions as F

from plumage.operators import archive, burst, report
from plumage.sources import files


def evaluated(spark, sizes):
    rows, us = [], 0
    for i, n in enumerate(sizes):
        us += 10_000_000
        for j in range(n):
            rows.append(("cam<1>", us + j * 1000, f"/p/{i:03}_{j:04}&.jpg", float(j), 5000.0, j % 2 == 0))
        us += n * 1000
    return burst.best_frames(burst.sessions(spark.createDataFrame(rows, "camera string, us long, path string, focus double, area double, has_eye boolean"), 1.0))


def test_every_image_has_a_card_and_every_page_a_link(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "PAGE_ROWS", 7)
    sizes = [3, 1, 20, 1, 2, 31, 1]
    frames = evaluated(spark, sizes)
    thumbs = spark.createDataFrame([("/p/000_0001&.jpg", "QUJD"), ("/p/000_0001&.jpg", "QUJD")], "path string, thumb string")
    told = files.write_files(report.burst_report(frames, "Trip <1>", thumbs), str(tmp_path)).collect()
    assert all(r.ok for r in told)
    pages = sorted((tmp_path / "pages").iterdir())
    texts = [p.read_text() for p in pages]
    assert len(pages) == -(-sum(sizes) // 7) and sum(t.count("class='image") for t in texts) == sum(sizes) and all(t.count("class='image") <= 7 for t in texts)
    assert sum(t.count("<section>") for t in texts) == sum(t.count("</section>") for t in texts)
    assert "".join(texts).count("QUJD") == 1 and "cam<1>" not in "".join(texts) and "&.jpg" not in "".join(texts) and "cam&lt;1&gt; / 0: 3 images, 2 kept" in texts[0]
    assert "(continued)" in texts[2] and "Single images" in texts[-1]
    names = [re.findall(r"<b>([^<]*)</b>", t) for t in texts]
    assert sum(names, []) == sorted(n for n in sum(names, []) if n[:3] in ("000", "002", "004", "005")) + sorted(n for n in sum(names, []) if n[:3] in ("001", "003", "006"))
    index = (tmp_path / "index.html").read_text()
    assert [int(x) for x in re.findall(r"<b>(\d+)</b>", index)] == [59, sum(r.keep for r in frames.collect()), sum(not r.keep for r in frames.collect()), 4] and "Trip &lt;1&gt;" in index
    seen, waiting = set(), ["index.html"]
    while waiting:
        at = waiting.pop()
        seen.add(at)
        for link in re.findall(r"href='([^']*)'", (tmp_path / at).read_text()):
            waiting.append(link.removeprefix("../"))
    assert {f"pages/{p.name}" for p in pages} <= seen and any(s.startswith("links1/") for s in seen)


def test_report_of_nothing_and_of_nulls(spark):
    frames = evaluated(spark, [2])
    empty = {r.dest: bytes(r.content).decode() for r in report.burst_report(frames.filter("false"), "none").collect()}
    assert set(empty) == {"index.html"} and re.findall(r"<b>(\d+)</b>", empty["index.html"]) == ["0", "0", "0", "0"]
    odd = frames.withColumns({"focus": F.lit(None).cast("double"), "has_eye": F.lit(None).cast("boolean"), "keep": F.lit(None).cast("boolean")})
    assert len(report.burst_report(odd, "odd").collect()) == 2


def test_tables_number_their_pages(spark, monkeypatch):
    monkeypatch.setattr(report, "PAGE_ROWS", 10)
    rows = spark.range(25).select(F.col("id").alias("k"), F.lit("<x>").alias("v"))
    pages = {r.page: r.html for r in report.html_pages(rows, ["k"], "T", []).collect()}
    assert sorted(pages) == [0, 1, 2] and [p.count("<tr>") for _, p in sorted(pages.items())] == [11, 11, 6] and "<x>" not in pages[0]


def test_report_read_again(spark, tmp_path):
    from plumage.sources import sinks

    nested = report.nested_report(evaluated(spark, [3, 1, 4]))
    sinks.write_report(nested, str(tmp_path / "r"))
    key = lambda r: (r.camera, r.burst_id)
    assert sorted(report.read_report(spark, str(tmp_path / "r")).collect(), key=key) == sorted(nested.collect(), key=key)


def test_thumbnails(spark):
    wide = np.arange(30 * 800 * 3, dtype=np.int64).reshape(30, 800, 3).astype(np.uint8)
    assert report.thumbnail(wide).shape == (15, 400, 3) and report.thumbnail(wide[:, :400]) .shape == (30, 400, 3)
    made = report.thumbnails(spark.createDataFrame([("a", bytearray(b"x")), ("b", None)], "path string, content binary"), lambda: lambda c: np.zeros((2, 3, 3), np.uint8), lambda: lambda p: b"ABC")
    assert {r.path: r.thumb for r in made.collect()} == {"a": "QUJD", "b": None}
    name = spark.range(1).select(report.stamped_name("r")).first()[0]
    assert re.fullmatch(r"r_\d{8}_\d{6}\.html", name)


def test_numbers_over_slices(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = sorted((r.k, r.seq) for r in archive.numbered(df, ["k"], 9).collect())
    assert [s for _, s in got] == list(range(1, 1001)) and archive.numbered(df.filter("false"), ["k"]).count() == 0
