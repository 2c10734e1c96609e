"""Hand-made cases of the region, name, archive, answer, budget and report operators."""

import json

import pytest
from pyspark.sql import functions as F

from plumage.config import PipelineConfig
from plumage.operators import answers, archive, refine, report, routing, spatial, taxonomy
from plumage.streaming import bursts

CAND = "image int, det int, rank int, idx int, confidence double, province string"


def refined(spark, rows, listed=(5, 6), regional=(), **kw):
    cand = spark.createDataFrame([(1, 0, i + 1, idx, c, "Z" if regional else None) for i, (idx, c) in enumerate(rows)], CAND)
    national = spark.createDataFrame([(i,) for i in listed], "idx int")
    region = spark.createDataFrame([("Z", i) for i in regional], "region string, idx int")
    return [r.idx for r in refine.refined(cand, region, national, **kw).orderBy("new_rank").collect()]


def test_refinement_cases(spark):
    assert refined(spark, [(1, 0.80), (5, 0.10)]) == [5]
    assert refined(spark, [(1, 0.80), (2, 0.70)]) == [1]
    assert refined(spark, [(1, 0.75)]) == []
    assert refined(spark, [(None, 0.90)]) == [None]
    assert refined(spark, [(1, 0.9 - 0.05 * i) for i in range(10)] + [(5, 0.01)]) == [1, 1, 1]
    assert refined(spark, [(5, 0.500), (6, 0.503)]) == [6, 5]
    assert refined(spark, [(i, 0.1) for i in range(12)], mode="none") == list(range(10))
    assert refined(spark, [(5, 0.49)], threshold=0.5) == []
    assert refined(spark, [(5, 0.9), (7, 0.1)], regional=(7,)) == [7]


def test_genus_cascade_and_unknowns(spark):
    tax = spark.createDataFrame([(0, "红嘴鸥", "鸻形目", "鸥科", "彩头鸥属", "Chroico ridi", "Chroico"), (1, "红嘴鸥二", "鸻形目", "鸥科", "彩头鸥属", "Chroico ridi", "Chroico")], "ord int, species_cn string, order_cn string, family_cn string, genus_cn string, name_la string, genus_la string")
    genera = spark.createDataFrame([("Larus", "鸻形目", "鸥科")], "genus string, order_cn string, family_cn string")
    names = spark.createDataFrame([(1, "x", "Chroico ridi"), (2, "我的", "Chroico sp"), (3, "", "Chroico sp"), (4, "红嘴鸥", ""), (5, "", "Larus x"), (6, None, None)], "id int, cn string, sci string")
    got = {r.id: (r.matched, r.species_cn, r.genus_cn) for r in taxonomy.classified(names, tax, genera).collect()}
    assert got == {1: ("sci", "红嘴鸥二", "彩头鸥属"), 2: ("genus", "我的", "彩头鸥属"), 3: ("genus", "红嘴鸥", "彩头鸥属"), 4: ("cn", "红嘴鸥", "彩头鸥属"), 5: ("table", "未知种", "Larus"), 6: ("none", "未知种", "未知属")}


def test_whitelist_rules(spark):
    rows = [("CN", "China", "a"), ("CN-35", "福建", "b"), ("CN-99", "CN-99", "c"), ("CN-36", " ", "d"), ("US", "US", "e"), ("CNX", "x", "f"), ("CN-37", "山东", "gone")]
    plain = spark.createDataFrame(rows, "region_key string, region_name string, species_code string")
    codes = spark.createDataFrame([(c, i) for i, c in enumerate("abcdef")], "code string, idx int")
    with pytest.raises(ValueError, match="place in the file"):
        taxonomy.whitelist(plain, codes)
    regions = plain.withColumn("ord", F.lit(0))
    assert [tuple(r) for r in taxonomy.whitelist(regions, codes).collect()] == [("福建", 1)]
    assert sorted(r.idx for r in taxonomy.national_list(regions, codes).collect()) == [0, 1, 2, 3]


def test_the_last_region_of_a_name_with_known_codes_counts(spark):
    rows = [(0, "CN-9", "x", "a"), (1, "CN-90", "x", "b"), (2, "CN-10", "x", "c"), (3, "CN-99", "x", "gone")]
    regions = spark.createDataFrame(rows, "ord int, region_key string, region_name string, species_code string")
    codes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "code string, idx int")
    assert [tuple(r) for r in taxonomy.whitelist(regions, codes).collect()] == [("x", 2)]


def test_collision_names_dodge_given_and_existing_ones(spark):
    import random

    rng = random.Random(7)
    names = ["a", "a", "a_1"] + [rng.choice(["a", "b", "a_1", "a_2", "a_3", "b_2", "a_1_1", "c_01", "c"]) for _ in range(120)]
    rows = [(i, n, rng.choice([".jpg", ".png"]) if i > 2 else ".jpg") for i, n in enumerate(names)]
    for there in (None, [("b", ".jpg"), ("b_1", ".jpg"), ("b", ".jpg"), ("a_4", ".png"), ("c_7", ".jpg"), ("z", ".jpg")]):
        existing = there and spark.createDataFrame(there, "stem string, ext string")
        got = {r.path: r.target for r in archive.collision_names(spark.createDataFrame(rows, "path int, stem string, ext string"), existing).collect()}
        old = {n + e for n, e in there or []}
        given, seen, want = {n + e for _, n, e in rows} | old, set(old), {}
        for i, n, e in rows:
            k = 0
            while (name := n + e if k == 0 else f"{n}_{k}{e}") in seen or k and name in given:
                k += 1
            seen.add(name)
            want[i] = name
        assert got == want and len(set(got.values()) - old) == len(rows)


def test_collision_names_keep_every_row_of_a_repeated_path(spark):
    rows = spark.createDataFrame([("p", "a", ".jpg", 1), ("p", "a", ".jpg", 1), ("q", "a", ".jpg", 2)], "path string, stem string, ext string, target int")
    got = archive.collision_names(rows).collect()
    assert sorted(r.target for r in got) == ["a.jpg", "a_1.jpg", "a_2.jpg"] and {r.target for r in got if r.path == "q"} == {"a_2.jpg"}


def test_locations(spark):
    square = lambda x, y, n=2.0: [{"x": x, "y": y}, {"x": x + n, "y": y}, {"x": x + n, "y": y + n}, {"x": x, "y": y + n}]
    schema = "ord int, name string, ring array<struct<x:double,y:double>>"
    provinces = spark.createDataFrame([(0, "A", square(0.0, 0.0)), (1, "B", square(1.0, 1.0)), (2, "C", square(50.0, 10.0))], schema)
    cities = spark.createDataFrame([(0, "A", "a1", square(0.0, 0.0, 1.0))], "ord int, parent string, name string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 51.0, 11.0), (4, 80.0, 80.0), (5, None, 1.0)], "pid int, lat double, lon double")
    got = {r.pid: (r.status, r.province, r.city) for r in spatial.location_meta(points, provinces, cities, "pid").collect()}
    assert got == {1: ("ok", "A", "a1"), 2: ("ok", "A", None), 3: ("ok", "C", None), 4: ("no_match", None, None), 5: ("no_coords", None, None)}


def test_remembered_places(spark):
    old = spark.createDataFrame([("a", 1.0, 2.0)], "name string, lat double, lon double")
    new = spark.createDataFrame([("a", 9.0, 9.0), ("b", 3.0, 4.0), ("c", None, None)], "name string, lat double, lon double")
    assert sorted(tuple(r) for r in spatial.remembered(old, new).collect()) == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]


def test_answers(spark):
    texts = [
        "中文名称：红嘴鸥；英文名称：Black-headed Gull；学名：*Larus ridibundus*；识别准确率：95%。", "这只鸟是**红嘴黑鹎**，相关信息如下：\n- **中文名称**：红嘴黑鹎\n- **英文名称**：Black Bulbul\n- **学名**：*Hypsipetes leucocephalus*",
        "主体类型：人像；简要说明：一位游客", "主体类型：其它动物；动物名称：变色树蜥；识别准确率：0%", "小䴙；没有", "白鹭", "", None, "Egret only",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, answer string")
    rows = {r.id: r for r in answers.candidates(df).collect()}
    assert (rows[0].chinese_name, rows[0].english_name, rows[0].scientific_name, rows[0].confidence) == ("红嘴鸥", "Black-headed Gull", "Larus ridibundus", 0.95)
    assert (rows[1].chinese_name, rows[1].english_name) == ("红嘴黑鹎", "Black Bulbul")
    assert rows[2].subject_type == "other" and rows[2].archive_root == "其它" and rows[3].confidence == 0.85
    assert rows[5].chinese_name == "白鹭" and rows[5].confidence == 0.9 and 6 not in rows and 7 not in rows


def test_model_choice(spark):
    usage = spark.createDataFrame([("d1", "a", 1_500_000), ("d1", "b", 10), ("d2", "a", 1_499_999), ("d3", "a", 1_900_000), ("d3", "b", 1_800_000)], "day string, model string, tokens long")
    assert {r.day: r.model for r in routing.picked_models(usage, ["a", " b ", "a"]).collect()} == {"d1": "b", "d2": "a", "d3": "b"}
    assert {r.model for r in routing.picked_models(usage, [], default="z").collect()} == {"z"}


def test_archive_names(spark):
    rows = spark.createDataFrame([(1, "x/y.JPG"), (2, "a.tar.gz"), (3, "noext"), (4, ".hidden")], "seq int, path string").withColumns({"order_cn": F.lit("a:b"), "family_cn": F.lit(None).cast("string"), "genus_cn": F.lit(""), "species_cn": F.lit("s"), "other": F.col("seq") == 4, "province": F.lit(None).cast("string"), "city": F.lit("c/d")})
    got = {r.seq: (r.directory, r.filename) for r in archive.copy_names(archive.directories(rows)).collect()}
    assert got[1] == ("a_b/未知科/未知属/s", "y_未知省_c_d_00001.JPG") and got[2][1] == "a.tar_未知省_c_d_00002.gz" and got[3][1] == "noext_未知省_c_d_00003.jpg"
    assert got[4] == ("a_b/未知科", ".hidden_未知省_c_d_00004.jpg")


def test_pages_escape(spark):
    rows = spark.createDataFrame([(1, "<b>"), (1, "a&b"), (2, None)], "page long, name string")
    pages = {r.page: r.html for r in report.html_pages(rows, ["name"], "T<", [("n", 3)]).collect()}
    assert "&lt;b&gt;" in pages[1] and "a&amp;b" in pages[1] and "<b><" not in pages[1] and "T&lt;" in pages[2]


def test_stream_of_bursts(spark, tmp_path):
    spark.sql("select 1 as camera, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,x) as ts from (select explode(array(0,1,2,10,11,5000)) as x)").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("camera int, ts timestamp").parquet(str(tmp_path / "in"))
    query = bursts.streaming_bursts(source, "1 second", "1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("bursts").collect()) == [2, 3]


def test_stream_of_rates(spark, tmp_path):
    spark.createDataFrame([("j", 1, 2.0), ("j", 2, 6.0), ("j", 0, 1.0)], "job string, done long, seconds double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("job string, done long, seconds double").parquet(str(tmp_path / "in"))
    query = bursts.moving_rate(source).writeStream.format("memory").queryName("rates").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    (row,) = spark.table("rates").collect()
    assert row.done == 2 and abs(row.rate - (0.65 * 2.0 + 0.35 * 3.0)) < 1e-12


def test_settings():
    c = PipelineConfig.from_json(json.dumps({"keep_ratio": 7, "keep_min": 0, "unknown": 1}), switch_ratio=0.01)
    assert (c.keep_ratio, c.keep_min, c.switch_ratio) == (1.0, 1, 0.1) and PipelineConfig.from_json(c.to_json()) == c
